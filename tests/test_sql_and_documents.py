import re

import pytest
from pyspark.errors import PySparkException
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlane.functions import text
from voltlane.operators import blocks, intervals, search, sqltool


def test_guard_takes_one_query_over_the_views_only(spark, sf):
    spark.range(3).selectExpr("id", "cast(id as string) s", "id as `set`", "array(id) a").createOrReplaceTempView("v")
    spark.range(3).createOrReplaceTempView("hidden")
    sqltool.register_functions(spark)
    for ok in (
        "select 1", " WITH a as (select 1 x) select * from a;", "select 'drop table x; --' as s", "select `set` from v where id > 1 order by 1 limit 2", "select 1 -- drop\n", "select s, count(*), sum(id) over (partition by s) from v group by s, id having count(*) > 0",
        "select * from v join (select id from v union all select 1) w using (id) where exists (select 1 from v x where x.id = v.id) and id in (select id from v)", "select explode(a) from v", "select transform(a, x -> x + 1), upper(s), date_format(timestamp_seconds(id), 'yyyy') from v",
        "select local_time(cast(id as double)) from v", "select * from v pivot (sum(id) for s in ('1', '2'))", "select case when id > 1 then round(sqrt(id), 2) end, coalesce(s, 'x'), s like '1%' from v", "select * from values (1, 2) as t(a, b)", "select max_by(s, id), percentile(id, 0.5) from v",
        "select lpad(s, 3, '0'), ceil(id / 2.0), floor(id), round(id, 1), to_date('2026-01-01') + interval 1 day, to_timestamp('2026-01-01'), regexp_extract(s, '(.)', 1), json_tuple('{}', 'a'), get_json_object('{}', '$.a') from v", "select row_number() over (order by id), sum(id) over (order by id rows between unbounded preceding and current row) from v",
    ):
        sqltool.guard(spark, ok, ["v"]).collect()
    path = f"{sf}/nation.parquet"
    for bad in (
        "", "drop table x", "select 1; select 2", "insert into t select 1", f"select * from parquet.`{path}`", f"select n_name from `parquet`.`{path}`", "select * from image.`/tmp`", f"with a as (select * from parquet.`{path}`) select * from a", f"select (select max(n_name) from parquet.`{path}`)",
        "with a as (select 1) insert into b select * from a", "set x=1", "select java_method('a','b')", "select try_reflect('java.lang.System', 'getProperty', 'user.home')", "select 1 where reflect('java.lang.System', 'exit', 1) is null", "select id from v where id in (select cast(reflect('java.lang.Math', 'abs', 1) as int))",
        "/* select */ drop table t", "select * from hidden", "select input_file_name() from v", "select transform(id) using 'cat' from v", "show tables", "describe v", "cache table v", "explain select 1", "create temp view w as select 1", "select current_user()", "select * from nowhere.v", "refresh table v",
    ):
        with pytest.raises((sqltool.Refused, PySparkException)):
            sqltool.guard(spark, bad, ["v"])
    assert "error" in sqltool.run(spark, "select * from hidden", ["v"]) and spark.catalog.tableExists("v") and not spark.catalog.tableExists("w")


WORDS = ["select", "drop", "table", "x", ";", "'", "--", "/*", "*/", '"', "insert", "into", "with", "as", "(", ")", "1", "`", "from", "\n", "hidden", "view", "parquet.`/etc`"]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(WORDS), max_size=12))
def test_guard_never_lets_a_command_through(spark, parts):
    try:
        plan = sqltool.guard(spark, " ".join(parts), [])._jdf.queryExecution().toString()
    except (sqltool.Refused, PySparkException):
        return
    assert not re.search(r"Command|InsertInto|DropTable|SetCatalog|Relation ", plan)


def test_run_caps_and_explains(spark):
    spark.range(500).selectExpr("id", "repeat('x', 5000) as s").createOrReplaceTempView("many")
    got = sqltool.run(spark, "select * from many order by id", ["many"])
    assert got["truncated"] and len(got["rows"]) == 200 and len(got["rows"][0]["s"]) == 2000
    assert "many(id, s)" in sqltool.run(spark, "select nope from many", ["many"])["error"]
    sqltool.register_functions(spark)
    assert spark.sql("select local_time(1772928000D), local_date(0D)").first()[:] == ("2026-03-07 19:00:00", "1969-12-31")


def test_samples_view(spark):
    s = spark.createDataFrame([("r", i, 100.0 + i) for i in range(6)], "run_id string, seq long, t double")
    laps = spark.createDataFrame([("r", 1, 0, 2), ("r", 2, 2, 5)], "run_id string, lap_number long, start_seq long, end_seq long")
    segs = spark.createDataFrame([("r", "Turn 1", 3, 4)], "run_id string, segment string, start_seq long, end_seq long")
    sqltool.register_samples(spark, s, laps, segs)
    rows = spark.sql("select seq, lap_number, segment, run_t from samples order by seq").collect()
    assert [tuple(r) for r in rows] == [(0, 1, None, 0.0), (1, 1, None, 1.0), (2, 2, None, 2.0), (3, 2, "Turn 1", 3.0), (4, 2, None, 4.0), (5, None, None, 5.0)]


def test_overlaps_touching_and_ties(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 4.0), (3, 50.0, 60.0)], "a_id long, a_start double, a_end double")
    b = spark.createDataFrame([(7, 4.0, 12.0), (8, 4.0, 12.0), (9, 10.0, 20.0)], "b_id long, b_start double, b_end double")
    assert sorted((r["a_id"], r["b_id"]) for r in intervals.overlap_pairs(a, b, 3.0).collect()) == [(1, 7), (1, 8)]
    assert [tuple(r) for r in intervals.best_overlap(a, b, 3.0).collect()] == [(1, 7, 0.75)]


def test_words_stems_and_matches(spark):
    row = spark.range(1).select(text.words(F.lit("The Brakes, of v1.2 & x re-wired.")).alias("w"), text.stems(F.lit("brakes wiring boxes used his")).alias("s"), text.matches(F.lit("Frosh projects list"), F.lit("the freshman project")).alias("m"), text.matches(F.lit(None).cast("string"), F.lit("a b")).alias("n"), text.matches(F.lit("x"), F.lit("steering")).alias("no")).first()
    assert row["w"] == ["brakes", "v1.2", "re-wired"] and row["s"] == ["brak", "wiring", "boxe", "used", "his"] and row["m"] and row["no"] is False
    assert row["n"] in (True, False)


def test_redaction(spark):
    hex40 = "0641917ea4e9feb9cda83477b57ac2654884f485"
    cases = {f"a {hex40} b": "a [redacted] b", f"https://x.y/{hex40}/z": f"https://x.y/{hex40}/z", "ghp_" + "a1" * 12: "[redacted]", "https://u:p@h/": "https://[redacted]@h/", "https://h/?token=abc&x=1": "https://h/?[redacted]&x=1", "plain": "plain"}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select(text.redact_keys(F.col("t")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got), got


HTML = """<h1>Guide</h1><p>Read <a href="https://drive.google.com/d/abcdefghijk">this</a>.<br/>Now.</p><ul><li>one</li><li>two</li></ul>
<table><tr><th>Login</th><th>Pin</th></tr><tr><td>a</td><td>b</td></tr></table><h2>Passwords</h2><p>hidden</p><h2>Next</h2><p>Password: x</p>
<ac:structured-macro ac:name="code"><ac:parameter ac:name="title">t</ac:parameter><ac:plain-text-body><![CDATA[x = 1
y]]></ac:plain-text-body></ac:structured-macro><script>no()</script>"""


def test_pages_become_blocks_and_chunks(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    got = pages.select("page_id", blocks.textify("html").alias("b")).orderBy("page_id").collect()
    b = [(x["kind"], x["text"], x["level"]) for x in got[0]["b"]]
    assert b[:4] == [("heading", "Guide", 1), ("para", "Read this. Now.", 0), ("para", "- one", 0), ("para", "- two", 0)] and ("code", "x = 1\ny", 0) in b
    assert got[0]["b"][1]["links"][0]["url"].startswith("https://drive") and got[1]["b"] == [] and got[2]["b"] == []
    texts = [r["text"] for r in blocks.scrub(blocks.block_rows(pages, blocks.textify("html"))).orderBy("page_id", "at").collect()]
    assert "[table removed: credentials]" in texts and "hidden" not in texts and "Password: x" not in texts and "Next" in texts
    chunks = blocks.page_chunks(spark.createDataFrame([(1, HTML)], "page_id long, html string")).collect()
    assert len(chunks) == 1 and "x = 1" not in chunks[0]["text"] and "```\ny\n```" in chunks[0]["text"]


PAGE = """a<b>b</b> c<div>d<p>e</p>f</div><h2>T <a href="http://u/1">link</a></h2>x<table><tr><th>H|1</th><td></td></tr><tr><td></td></tr>
<tr><td>p<p>q</p><table><tr><td>in</td></tr></table></td><td>see http://w/2 now</td></tr></table>tail<ac:link><ri:page ri:content-title="Other"/></ac:link>
<ac:structured-macro ac:name="widget"><ac:parameter ac:name="url">https://v/3</ac:parameter><ac:parameter>no</ac:parameter></ac:structured-macro><a>plain</a><h1></h1>"""


def test_blocks_of_odd_markup():
    got = [(b["kind"], b["text"], b["level"], b["rows"], b["header"], [x["url"] for x in b["links"]]) for b in blocks.blocks_of(PAGE)]
    assert got == [
        ("para", "ab c", 0, None, False, []), ("para", "d", 0, None, False, []), ("para", "e", 0, None, False, []), ("para", "f", 0, None, False, []),
        ("heading", "T link", 2, None, False, ["http://u/1"]), ("para", "x", 0, None, False, []),
        ("table", "", 0, [["H|1", ""], ["p q in", "see http://w/2 now"]], True, ["http://w/2"]),
        ("para", "tailOther plain", 0, None, False, ["https://v/3"]),
    ]


FIELDS = "page_id long, at int, kind string, text string, level int, rows array<array<string>>, header boolean, links array<struct<url:string,text:string>>"


def as_rows(spark, *pages):
    return spark.createDataFrame([(k, i, *b.values()) for k, page in enumerate(pages) for i, b in enumerate(page)], FIELDS)


def test_chunks_split_and_merge(spark):
    para = lambda n, links=(): blocks.block("para", " ".join(["w"] * n), links=links)
    head = lambda text, level: blocks.block("heading", text, level)
    long = [head("A", 1), *[para(150) for _ in range(6)], head("B", 2), para(5), head("C", 2), para(50)]
    small = [para(3, [("u", "1"), ("v", "2")]), head("X", 2), head("Y", 4), para(4, [("u", "3")]), head("Z", 1), blocks.block("table", rows=[["a|b", "c"], ["d", "e"]], header=True), head("deep", 5), head("end", 3)]
    got = blocks.chunk(as_rows(spark, long, [], [head("only", 1)], small)).orderBy("page_id", "ordinal").collect()
    first = [r for r in got if r["page_id"] == 0]
    assert [len(c["text"].split()) for c in first[:3]] == [300, 300, 300] and [c["ordinal"] for c in first] == [0, 1, 2, 3]
    assert first[3]["heading"] == "A" and first[3]["text"].startswith("B") and "C" in first[3]["text"]
    rest = [tuple(r)[:4] + ([tuple(x) for x in r["links"]],) for r in got if r["page_id"] != 0]
    assert rest == [(3, 0, "X · Z", "w w w\n\nX\n\nX > Y\n\nw w w w\n\nZ\n\n| a/b | c |\n|---|---|\n| d | e |\n\ndeep", [("u", "1"), ("v", "2")])]
    assert [b["kind"] for b in blocks.file_blocks("a.md", "# T\ntext\n```\ncode\n```\n")] == ["heading", "para", "code"]
    assert blocks.file_blocks("a.csv", "a,b\n1,2\n")[0]["rows"] == [["a", "b"], ["1", "2"]]
    assert blocks.leaf_paths({"a": {"b": [1, 2]}, "c": float("nan")}) == {"$.a.b[0]": 1, "$.c": None}


def test_scrub_sections_tables_and_lines(spark):
    para, head = blocks.block, lambda text, level: blocks.block("heading", text, level)
    page = [
        para("para", "password:\n\nhunter2\nfine\nlogin: a\nlogin: b\nlogin: c\nv\nstays"), head("Passwords", 3), para("para", "gone"), head("deeper", 4), para("para", "gone too"), head("Open", 3),
        para("table", rows=[["a", "secret"], ["b", "c"]], header=False), para("para", "the password is " + "x" * 90 + "\nkept"), para("code", "pwd"), para("para", "taken\nkept"), para("para", "token: 1"), head("H", 2), para("para", "kept after"),
    ]
    got = [(r["kind"], r["text"], r["rows"]) for r in blocks.scrub(as_rows(spark, page)).orderBy("at").collect()]
    assert got == [
        ("para", "fine\nstays", None), ("heading", "Open", None), ("table", "", [["b", "c"]]), ("para", "kept", None), ("para", "kept", None), ("heading", "H", None), ("para", "kept after", None),
    ]


def test_ranking_factors(spark):
    q = text.stems(F.lit("brake sensor"))
    now = F.lit("2026-01-01").cast("timestamp")
    row = spark.range(1).select(
        search.title_factor(q, F.lit("Brake Sensors")).alias("exact"), search.title_factor(q, F.lit("The brake guide")).alias("half"), search.path_factor(q, F.array(F.lit("Sensors"))).alias("path"), search.recency_factor(F.lit("2025-01-01T00:00:00"), now).alias("year"), search.recency_factor(F.lit("bad"), now).alias("bad"),
        search.admin_factor(F.lit("who"), F.lit("Sam's resume"), F.array(F.lit("x"))).alias("admin"), search.subteam_factor(F.lit("elec jobs"), F.lit("t"), F.array(F.lit("Mechanical"))).alias("other"), search.kind_factor(F.lit("work_log")).alias("kind"),
    ).first()
    assert row["exact"] == 1.75 and row["half"] == 1.25 and row["path"] == pytest.approx(1.2) and row["year"] == pytest.approx(1.15) and row["bad"] == 1.0
    assert (row["admin"], row["other"], row["kind"]) == (0.4, 0.6, 0.5)


def test_vectors_in_blocks_and_zero_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])], "doc_id long, v array<float>")
    q = v.select(F.col("doc_id").alias("query_id"), "v").where("query_id % 7 = 0")
    one, many = (sorted(tuple(r) for r in search.vector_top(v.repartition(3), q, 5, block=b).collect()) for b in (1000, 2))
    assert one == many and len(one) == 30
    assert search.vector_top(v, q.limit(0), 5).count() == 0
