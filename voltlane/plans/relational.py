"""Queries on the star-schema tables: joins, sets, windows, aggregates, scalars, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlane.functions.scalar import day_start, epoch_s, local_date, local_time, normalized
from voltlane.operators import catalog, intervals, library
from voltlane.registry import query, table


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def local_supplier_volume(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    j = j.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("x"), 2).alias("revenue"), F.count("*").alias("n"))


def _spans(spark, sf_dir, status, side):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    start = epoch_s("o_orderdate")
    return o.select(F.col("o_orderkey").alias(f"{side}_id"), start.alias(f"{side}_start"), (start + (1 + F.col("o_orderkey") % 5) * 7200.0).alias(f"{side}_end"))


SPANS = "sp AS (SELECT o_orderkey AS id, o_orderstatus AS st, epoch_us(o_orderdate) / 1e6 AS s, epoch_us(o_orderdate) / 1e6 + (1 + o_orderkey % 5) * 7200.0 AS e FROM orders)"


@query(f"""WITH {SPANS}, p AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) AS f FROM sp a JOIN sp b ON a.st = 'F' AND b.st = 'O' AND a.s < b.e AND b.s < a.e)
SELECT a_id, arg_max(b_id, {{'f': f, 'b': -b_id}}) AS b_id, round(max(f), 6) AS fraction FROM p WHERE f > 0.5 GROUP BY 1""")
def interval_overlap_best_match(spark, sf_dir):
    m = intervals.best_overlap(_spans(spark, sf_dir, "F", "a"), _spans(spark, sf_dir, "O", "b"), cell=86_400.0)
    return m.select("a_id", "b_id", F.round("fraction", 6).alias("fraction"))


@query(f"WITH {SPANS} SELECT a.id AS a_id, count(*) AS n FROM sp a JOIN sp b ON a.st = 'F' AND b.st = 'P' AND a.s <= b.e AND b.s <= a.e GROUP BY 1")
def overlapping_recordings(spark, sf_dir):
    """Closed overlap: intervals that only touch count too (their ends are widened by a microsecond before the join)."""
    a, b = _spans(spark, sf_dir, "F", "a"), _spans(spark, sf_dir, "P", "b").withColumns({"b_start": F.col("b_start") - 5e-7, "b_end": F.col("b_end") + 5e-7})
    return intervals.overlap_counts(a, b, 86_400.0)


@query("""SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""")
def dynamic_filter_list(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    page = catalog.listing(table(spark, sf_dir, "orders"), name="URGENT", name_columns=("o_orderpriority",), since=day("1995-01-01"), until=day("1997-01-01"), time=F.col("o_orderdate"), equal={"o_orderstatus": "F", "o_custkey": None}, order=[F.desc("o_totalprice"), "o_orderkey"], limit=9999)
    return page.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def paged_list(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    total = rows.agg(F.count("*").alias("total"))
    page = catalog.listing(rows, order=["o_orderdate", "o_orderkey"], limit=50, offset=100).select("o_orderkey")
    return page.join(F.broadcast(total))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_pending(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("SELECT n_regionkey::INT AS k FROM nation INTERSECT SELECT r_regionkey::INT FROM region")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("k")).intersect(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("k")))


@query("SELECT 'turn' AS kind, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 'straight', c_custkey, c_name FROM customer")
def union_segments(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("turn").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.lit("straight").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return s.unionByName(c)


@query("""WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL OUTER JOIN b USING (k)""")
def full_outer_fuse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    b = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("y"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0).cast("long")).alias("y"))


W = "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2,
first_value(o_orderkey) OVER w AS fv, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(o_orderkey, 2) OVER w AS n2, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3 FROM orders {W}""")
def window_suite(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = "o_orderkey"
    return table(spark, sf_dir, "orders").select(
        k, F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("nt"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
        F.lag(k).over(w).alias("prev"), F.lead(k, 2).over(w).alias("next2"), F.first(k).over(w).alias("fv"), F.last(k).over(whole).alias("lv"), F.nth_value(k, 2).over(w).alias("n2"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("s3"),
    )


@query("""SELECT o_orderkey, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM orders""")
def groups_frame(spark, sf_dir):
    """A GROUPS frame, which Spark lacks: ranges over the dense rank of the order key."""
    d = table(spark, sf_dir, "orders").withColumn("g", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")))
    w = Window.partitionBy("o_custkey").orderBy("g").rangeBetween(-1, 0)
    return d.select("o_orderkey", F.sum(F.floor("o_totalprice")).over(w).alias("s"))


@query("""SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS s, round(avg(l_quantity), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi, count(DISTINCT l_suppkey) AS d, coalesce(sum(CASE WHEN l_quantity > 9999 THEN l_quantity END), 0.0) AS total, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS listed FROM lineitem GROUP BY 1 HAVING count(*) > 10""")
def agg_suite(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a = l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.countDistinct("l_suppkey").alias("d"), F.coalesce(F.sum(F.when(F.col("l_quantity") > 9999, F.col("l_quantity"))), F.lit(0.0)).alias("total"), F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("listed"))
    return a.where("n > 10")


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT AS g, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE r(k, d) AS (SELECT min(n_nationkey)::INT, 0 FROM nation UNION ALL SELECT k + 1, d + 1 FROM r WHERE d < 24) SELECT k, d, n_name FROM r JOIN nation ON n_nationkey = k""")
def recursive_cte(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("__nation")
    return spark.sql("WITH RECURSIVE r(k, d) AS (SELECT int(min(n_nationkey)), 0 FROM __nation UNION ALL SELECT k + 1, d + 1 FROM r WHERE d < 24) SELECT k, d, n_name FROM r JOIN __nation ON n_nationkey = k")


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, json_valid(props) AS ok, coalesce(props->>'$.missing', 'none') AS missing, to_json({'id': event_id, 'type': event_type}) AS packed FROM events""")
def json_scalar_suite(spark, sf_dir):
    p = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", p.alias("k"), F.try_parse_json("props").isNotNull().alias("ok"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("packed"))


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, substr(c_name, 3, 4) AS sub, strpos(c_name, '#') AS at, replace(c_name, '0', 'o') AS rep, ltrim(c_name, 'C') AS lt, lpad(c_custkey::VARCHAR, 8, '0') AS pad, hex(c_mktsegment) AS hx, unicode(c_name) AS code, c_name ILIKE 'CUST%' AS lk, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS norm, printf('%s-%d', c_mktsegment, c_custkey) AS fmt, reverse(c_name) AS rev FROM customer""")
def string_suite(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(n).alias("up"), F.lower("c_mktsegment").alias("low"), F.length(n).cast("long").alias("len"), F.substring(n, 3, 4).alias("sub"), F.instr(n, "#").cast("long").alias("at"), F.replace(n, F.lit("0"), F.lit("o")).alias("rep"), F.ltrim(n, F.lit("C")).alias("lt"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("pad"),
        F.hex("c_mktsegment").alias("hx"), F.ascii(n).alias("code"), n.ilike("CUST%").alias("lk"), normalized(n).alias("norm"), F.format_string("%s-%d", "c_mktsegment", "c_custkey").alias("fmt"), F.reverse(n).alias("rev"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate)::INT AS y, (epoch_us(o_orderdate) / 1e6)::BIGINT AS unix, round(epoch_us(o_orderdate) / 1e6 / 86400 + 2440587.5, 6) AS julian, strftime(o_orderdate - INTERVAL 14 DAY, '%Y-%m-%d') AS back, strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS local_time, strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d') AS local_date,
 (epoch_us(timezone('UTC', timezone('America/New_York', date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 1 DAY))) / 1e6)::BIGINT AS until_s FROM orders""")
def date_suite(spark, sf_dir):
    d, s = F.col("o_orderdate"), epoch_s("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("d"), F.year(d).alias("y"), s.cast("long").alias("unix"), F.round(s / 86400 + 2440587.5, 6).alias("julian"), F.date_format(d - F.expr("INTERVAL 14 DAYS"), "yyyy-MM-dd").alias("back"), local_time(s).alias("local_time"), local_date(s).alias("local_date"), day_start(F.date_add(F.to_date(d), 1)).cast("long").alias("until_s"))


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 2 END AS b FROM customer)
SELECT c_custkey, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END AS hi, nullif(c_custkey % 4, 0)::INT AS z, coalesce(a, b, 0) AS c, a IS NOT DISTINCT FROM b AS same, TRY_CAST('x' || c_custkey AS INT) AS bad, round(a, 4) AS a FROM v""")
def null_semantics(spark, sf_dir):
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").select(k, F.when(k % 3 != 0, F.col("c_acctbal")).alias("a"), F.when(k % 5 != 0, F.col("c_acctbal") / 2).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select(k, F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)).alias("hi"), F.nullif(k % 4, F.lit(0)).cast("int").alias("z"), F.coalesce(a, b, F.lit(0.0)).alias("c"), a.eqNullSafe(b).alias("same"), F.concat(F.lit("x"), k.cast("string")).try_cast("int").alias("bad"), F.round(a, 4).alias("a"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey = max(o_orderkey)) AS lines FROM orders GROUP BY 1) SELECT * FROM s""")
def correlated_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    return o.join(lines, "k", "left").select("o_custkey", "n", F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, l_returnflag AS lane, l_quantity AS size, epoch_us(l_shipdate) / 1e6 AS la FROM lineitem), k AS (SELECT *, la < 900000000.0 - 60000000.0 AS idle FROM e),
 r AS (SELECT *, sum(CASE WHEN idle THEN 0 ELSE size END) OVER (PARTITION BY lane ORDER BY la DESC, entry_id ROWS UNBOUNDED PRECEDING) AS held FROM k)
SELECT lane, CASE WHEN idle THEN 'idle' ELSE 'over cap' END AS reason, count(*) AS n, sum(size) AS freed FROM r WHERE idle OR held > 100000 GROUP BY 1, 2""")
def eviction_plan(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    e = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.col("l_returnflag").alias("lane"), F.col("l_quantity").alias("size"), epoch_s("l_shipdate").alias("last_access"))
    return catalog.evictions(e, 900_000_000.0, 60_000_000.0, 100_000.0, ["lane"]).groupBy("lane", "reason").agg(F.count("*").alias("n"), F.sum("size").alias("freed"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM r WHERE run <= 60000 GROUP BY 1""")
def running_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    d = catalog.running_total(d, "n_chars", [F.desc("n_chars"), F.asc("doc_id")], ["source"], "run").where("run <= 60000")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH f AS (SELECT o_custkey AS id, string_agg(h, chr(10) ORDER BY h) AS x FROM (SELECT o_custkey, sha256(o_orderpriority || o_orderstatus) AS h FROM orders) GROUP BY 1) SELECT sha256(x) AS content_key, count(*) AS copies, min(id) AS first_id FROM f GROUP BY 1""")
def content_hash_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording_id"), F.sha2(F.concat("o_orderpriority", "o_orderstatus"), 256).alias("sha256"))
    return catalog.content_key(files).groupBy("content_key").agg(F.count("*").alias("copies"), F.min("recording_id").alias("first_id"))


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS m FROM customer), n AS (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS v, CASE WHEN count(*) > 12 THEN 'BUSY' END AS m FROM orders GROUP BY 1)
SELECT k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(n.m, o.m) AS m FROM o FULL OUTER JOIN n USING (k)""")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("m"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("v"), F.when(F.count("*") > 12, "BUSY").alias("m"))
    return catalog.upsert(old, new, ["k"], keep_old_if_null=("m",))


@query("SELECT l_suppkey AS recording_id, l_returnflag AS stream, sum(l_quantity) AS n, min(epoch_us(l_shipdate) / 1e6)::BIGINT AS first_ts, max(epoch_us(l_shipdate) / 1e6)::BIGINT AS last_ts FROM lineitem GROUP BY 1, 2")
def stream_ranges(spark, sf_dir):
    at = epoch_s("l_shipdate").cast("long")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recording_id"), F.col("l_returnflag").alias("stream"), F.col("l_quantity").alias("n"), at.alias("first_ts"), at.alias("last_ts"))
    return catalog.stream_ranges(s)


@query("SELECT s.k AS status, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(k) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON o_orderstatus = s.k")
def status_counts(spark, sf_dir):
    known = spark.createDataFrame([(k,) for k in "FOPX"], "status string")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return known.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS lane, CASE WHEN o_orderkey % 7 = 0 THEN 'scan' ELSE 'parse' END AS kind, o_custkey AS rec, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS c, o_orderkey % 3 AS att FROM orders)
SELECT lane, arg_min(job_id, {'c': c, 'j': job_id}) AS job_id FROM j WHERE status = 'queued' AND att < 2 AND (kind = 'scan' OR NOT EXISTS (SELECT 1 FROM j s WHERE s.rec = j.rec AND s.kind = 'scan' AND s.status IN ('queued', 'running'))) GROUP BY 1""")
def next_jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    jobs = table(spark, sf_dir, "orders").select(k.alias("job_id"), F.col("o_orderpriority").alias("lane"), F.when(k % 7 == 0, "scan").otherwise("parse").alias("kind"), F.col("o_custkey").alias("recording_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (k % 3).alias("attempts"))
    return library.next_jobs(jobs)


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT * FROM (SELECT k, CASE WHEN b.v IS NULL THEN 'add' WHEN a.v IS NULL THEN 'delete' WHEN a.v <> b.v THEN 'update' END AS action FROM a FULL OUTER JOIN b USING (k)) WHERE action IS NOT NULL""")
def changed_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    newest = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return library.changed(newest("o_orderstatus <> 'P'"), newest("o_orderpriority <> '1-URGENT'"), ["k"], ["v"])


@query("""SELECT s_name AS author, count(*) AS commits, sum(l_quantity) AS added, sum(l_linenumber)::BIGINT AS deleted, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS repos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def contributions(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    c = j.select(F.col("s_name").alias("author"), F.col("l_returnflag").alias("repo"), F.lit(1).alias("commits"), F.col("l_quantity").alias("added"), F.col("l_linenumber").alias("deleted"))
    return library.contributions(c).withColumn("repos", F.array_join("repos", ","))


@query("""WITH r AS (SELECT o_orderkey, strftime(timezone('America/New_York', timezone('UTC', o_orderdate)), '%Y-%m-%d') || '-' || right(o_custkey::VARCHAR, 6) AS stem, o_orderdate FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY o_orderdate, o_orderkey) AS n FROM r) SELECT o_orderkey, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS run_id FROM n""")
def assigned_run_ids(spark, sf_dir):
    """Run ids of recordings; here the id that gives the six characters is the customer's, so some meet on a day."""
    o = table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderkey"), F.col("o_custkey")).alias("r"), epoch_s("o_orderdate").alias("start_s"))
    stem = F.concat_ws("-", local_date(F.col("start_s")), F.right(F.col("r.o_custkey").cast("string"), F.lit(6)))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("start_s", "r.o_orderkey"))
    named = o.withColumn("stem", stem).withColumn("n", n)
    return named.select("r.o_orderkey", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("n").cast("string"))).alias("run_id"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS category, CASE c_custkey % 3 WHEN 1 THEN 'manual' WHEN 2 THEN 'auto' END AS method FROM customer), l AS (SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS wanted FROM nation)
SELECT c_custkey, CASE WHEN method = 'manual' THEN category WHEN wanted IS NOT NULL THEN wanted WHEN method IS DISTINCT FROM 'auto' THEN category END AS category, CASE WHEN method = 'manual' THEN method WHEN wanted IS NOT NULL THEN 'auto' WHEN method IS DISTINCT FROM 'auto' THEN method END AS category_method,
 coalesce(method, '') <> 'manual' AND ((wanted IS NOT NULL AND (category IS DISTINCT FROM wanted OR method IS DISTINCT FROM 'auto')) OR (wanted IS NULL AND coalesce(method, '') = 'auto')) AS changed FROM r LEFT JOIN l ON n_nationkey = c_nationkey""")
def auto_category(spark, sf_dir):
    """Customers as recordings, nations as the places that give a category."""
    k = F.col("c_custkey") % 3
    r = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("location_id"), F.when(k > 0, F.col("c_mktsegment")).alias("category"), F.when(k == 1, "manual").when(k == 2, "auto").alias("category_method"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("location_id"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("default_category"))
    return catalog.auto_category(r, places).select("c_custkey", "category", "category_method", "changed")
