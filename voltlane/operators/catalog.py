"""Catalog of recordings: filtered listings, content dedup, linking, eviction and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Asked stretches, by cell, that are broadcast at most; more meet the recordings by a shuffle.
BROADCAST_ASKS = 1_000_000
#: Files of one task that sorts them or finds their asks, about; a dictionary of a Parquet column holds some 130,000 values.
TASK_FILES = 50_000
#: Files and asks that meet as bundles, powers of two: their pairs are about a page of a Parquet column (20,000 rows).
FILE_BUNDLE, ASK_BUNDLE = 64, 256
#: Rows of one range of a running total, about.
RANGE_ROWS = 250_000


def listing(rows: DataFrame, *, name: str | None = None, name_columns: tuple[str, ...] = (), since=None, until=None, time: Column | None = None, equal: dict | None = None, order: list | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """A filtered page. Falsy filters are left out; the time window is half open; limit is held to 1..500.

    `name` is looked for in all `name_columns`, whatever the case."""
    if name:
        like = None
        for c in name_columns:
            hit = F.contains(F.lower(F.col(c)), F.lit(name.lower()))
            like = hit if like is None else like | hit
        rows = rows.where(like)
    if since is not None:
        rows = rows.where(time >= since)
    if until is not None:
        rows = rows.where(time < until)
    for c, v in (equal or {}).items():
        if v:
            rows = rows.where(F.col(c) == v)
    if order:
        rows = rows.orderBy(*order)
    return rows if limit is None else rows.offset(offset).limit(min(max(limit, 1), 500))


def content_key(files: DataFrame) -> DataFrame:
    """recording_id and a hash of its files' hashes, whatever their order."""
    return files.groupBy("recording_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("sha256"))), 256).alias("content_key"))


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """`old` with the rows of `new` put over it by key; the named columns keep their old value where the new one is null."""
    marked = new.withColumn("__new", F.lit(True))
    both = old.alias("o").join(marked.alias("n"), key, "full_outer")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old_if_null else F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*key, *[value(c).alias(c) for c in old.columns if c not in key])


def running_total(rows: DataFrame, size: str, order: list[Column], group: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` with the sum of `size` over the rows of the group up to each, in `order`, which must leave no ties.

    Rows are sorted into ranges of about `range_rows`; each range adds up its own rows to the total of the ranges before, so a group may be of any size."""
    # kept, so that both reads below see the same ranges
    n = 1 + rows.count() // range_rows
    dealt = rows.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    own = dealt.groupBy(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__range").alias("__of")).agg(F.sum(size).alias("__own"))
    keys = [f"__g{k}" for k in range(len(group))]
    before = own.withColumn("__before", F.sum("__own").over(Window.partitionBy(*keys).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))).drop("__own")
    met = dealt.join(before, reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)), F.col("__range") == F.col("__of")))
    met = met.repartition(n, "__range")
    inside = F.sum(size).over(Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # null while no row of the group had a size, as a window over the whole group has it
    total = F.when(inside.isNull(), F.col("__before")).otherwise(inside + F.coalesce("__before", F.lit(0)))
    return met.withColumn(name, total).drop("__range", "__of", "__before", *keys)


def evictions(entries: DataFrame, now_s: float, max_age_s: float, cap: float, group: list[str]) -> DataFrame:
    """Cache entries to drop: idle ones, and of the others the least recently used beyond the cap of their group."""
    idle = F.col("last_access") < now_s - max_age_s
    counted = entries.withColumn("__size", F.when(idle, 0).otherwise(F.col("size")))
    held = running_total(counted, "__size", [F.desc("last_access"), F.asc("entry_id")], group, "__held")
    return held.withColumn("reason", F.when(idle, "idle").when(F.col("__held") > cap, "over cap")).where("reason is not null").drop("__size", "__held")



def stream_ranges(streams: DataFrame) -> DataFrame:
    """Streams of split files as one: counts add up, first and last times span all files."""
    return streams.groupBy("recording_id", "stream").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def auto_category(recordings: DataFrame, locations: DataFrame) -> DataFrame:
    """`recordings` (location_id, category, category_method, ...) with the default category of the place where each was
    made, and `changed`. What was set by hand stays; an automatic category goes where the place gives none any more."""
    wanted = locations.select("location_id", F.col("default_category").alias("__wanted"))
    j = recordings.join(wanted, "location_id", "left")
    manual = F.coalesce(F.col("category_method") == "manual", F.lit(False))
    auto = F.coalesce(F.col("category_method") == "auto", F.lit(False))
    category = F.when(manual, F.col("category")).when(F.col("__wanted").isNotNull(), F.col("__wanted")).when(~auto, F.col("category"))
    method = F.when(manual, F.col("category_method")).when(F.col("__wanted").isNotNull(), F.lit("auto")).when(~auto, F.col("category_method"))
    j = j.withColumns({"__c": category, "__m": method})
    changed = ~(F.col("__c").eqNullSafe(F.col("category")) & F.col("__m").eqNullSafe(F.col("category_method")))
    done = j.withColumns({"changed": changed, "category": F.col("__c"), "category_method": F.col("__m")})
    return done.select(*recordings.columns, "changed")


def gps_box(fixes: DataFrame) -> DataFrame:
    """run_id and the box and number of its fixes; runs without a fix are left out, (0, 0) is none."""
    real = fixes.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    return real.groupBy("run_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.count("*").alias("fixes"))


def csv_time_range(rows: DataFrame) -> DataFrame:
    """run_id, first and last time (s) and number of rows of flat CSV files; timestamps that are no whole numbers count as rows only."""
    return rows.groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def apart(spans: DataFrame) -> DataFrame:
    """ask_id, lo, hi, __before: the spans of each ask with those that share a point made one, and the end of the one before."""
    mine = Window.partitionBy("ask_id").orderBy("lo", "hi")
    reach = F.max("hi").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.distinct().withColumn("__new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("__island", F.sum("__new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("ask_id", "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__island")
    return spans.withColumn("__before", F.lag("hi").over(mine))


def bundled(rows: DataFrame, size: int, n: int | None = None) -> GroupedData:
    """`rows` as they stand in their partitions, in groups of up to `size` (a power of two) rows of one __cell, dealt over `n` tasks."""
    rows = rows.withColumn("__bundle", F.expr(f"monotonically_increasing_id() div {size}"))
    return (rows if n is None else rows.repartition(n, "__cell", "__bundle")).groupBy("__cell", "__bundle")


def find_files(asks: DataFrame, recordings: DataFrame, files: DataFrame, cell_s: float = 86_400.0) -> DataFrame:
    """Files that cover each asked run, or only a stretch of it: ask_id and the columns of `recordings` and `files`.

    asks: ask_id, run_id, start_ts, end_ts (null: from the run's own recording). A recording is found if it is the run's
    own or overlaps the stretch (both ends count), so footage of other sources at that time is found too. The two ways are
    joins of their own, by run and by cells of `cell_s` seconds, and a recording that both find counts once.
    recording_id is the key of `recordings`; an ask may have several stretches. The result holds each ask's own files of all
    sources, so it grows with asks times recordings of their time; nothing of that size is shuffled."""
    few = asks.limit(BROADCAST_ASKS + 1).count() <= BROADCAST_ASKS
    own = recordings.where("run_id is not null").select("run_id", F.col("recorded_start").alias("__start"), F.col("recorded_end").alias("__end"))
    if few:
        own = own.join(F.broadcast(asks.select("run_id").distinct()), "run_id", "left_semi")
    span = own.groupBy("run_id").agg(F.min("__start").alias("__start"), F.max("__end").alias("__end"))
    # asks without a run are one key, which a shuffle would put into one task
    wanted = asks.join(F.broadcast(span) if few else span, "run_id", "left").select("ask_id", F.col("run_id").alias("__run"), F.coalesce("start_ts", "__start").alias("lo"), F.coalesce("end_ts", "__end").alias("hi")).distinct()
    stretches = F.collect_list(F.when(F.col("lo") <= F.col("hi"), F.struct("lo", "hi")))
    wanted = wanted.withColumn("__all", stretches.over(Window.partitionBy("ask_id")))
    meets = lambda lo, hi: (F.col("recorded_start") <= hi) & (F.col("recorded_end") >= lo)
    none_of = lambda c: (F.size(c) == 0) | ~F.exists(c, lambda x: F.coalesce(meets(x["lo"], x["hi"]), F.lit(False)))
    cell = lambda c: F.floor(F.col(c) / cell_s)
    cells = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    timed = apart(wanted.where("lo <= hi").select("ask_id", "lo", "hi")).withColumn("__cell", cells("lo", "hi"))
    near = recordings.where("recorded_start <= recorded_end").withColumn("__cell", cells("recorded_start", "recorded_end"))
    sent = timed.limit(BROADCAST_ASKS + 1).count() <= BROADCAST_ASKS
    if sent:
        near = near.join(F.broadcast(timed.select("__cell").distinct()), "__cell", "left_semi")
    # files go into the join with their recordings: pairs of an ask and a file are the result and are not dealt again
    held = [*recordings.columns, *[c for c in files.columns if c != "recording_id"]]
    dealt = near.join(files, "recording_id")
    sorts = 1 + files.count() // TASK_FILES
    plain = [f.name for f in dealt.schema if isinstance(f.dataType, T.AtomicType)]
    order = list(dict.fromkeys(["__cell", "recorded_start", "recorded_end", "recording_id", *plain]))
    dealt = dealt.repartitionByRange(sorts, *order).sortWithinPartitions(*order)
    # the asks of a few cells may find nearly all; their files are few bytes, which would else be few tasks
    n = max(4 * files.sparkSession.sparkContext.defaultParallelism, sorts)
    # bundles of files meet bundles of asks, both of one time: the rows of the result come in small rectangles, whose columns
    # are runs and repeats, so that Parquet writes them in a fraction of a byte a row, however many asks a file meets
    dealt = bundled(dealt, FILE_BUNDLE, n).agg(F.collect_list(F.struct(*held)).alias("__files"), F.min("recorded_start").alias("__from"), F.max("recorded_end").alias("__to"))
    asked = bundled(timed.orderBy("__cell", "lo", "hi", "ask_id"), ASK_BUNDLE).agg(F.collect_list(F.struct("ask_id", "lo", "hi", "__before")).alias("__asks"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    dealt, asked = dealt.drop("__bundle"), asked.drop("__bundle").withColumnRenamed("__cell", "__at")
    met = dealt.join(F.broadcast(asked) if sent else asked, (F.col("__cell") == F.col("__at")) & (F.col("__from") <= F.col("__hi")) & (F.col("__to") >= F.col("__lo")))
    # this first explode is not compiled, as it holds a lambda, and so hands on file by file: compiled stages hold all rows of
    # a row that they read, which would be all pairs of a bundle; the second one, over asks, is compiled
    near_all = F.filter("__files", lambda f: (f["recorded_start"] <= F.col("__hi")) & (f["recorded_end"] >= F.col("__lo")))
    met = met.select("__cell", "__asks", F.explode(near_all).alias("__f")).select("__cell", "__asks", "__f.*")
    met = met.select("__cell", *held, F.explode("__asks").alias("__a")).select("__cell", *held, "__a.*")
    first = F.col("__cell") == F.floor(F.greatest("lo", "recorded_start") / cell_s)
    # the stretches are apart, so a recording overlaps none before this one if it starts after the end of the last
    fresh = F.col("__before").isNull() | (F.col("recorded_start") > F.col("__before"))
    near = met.where(meets(F.col("lo"), F.col("hi")) & first & fresh)
    timeless = F.coalesce(F.col("recorded_start") > F.col("recorded_end"), F.lit(True))
    runs = wanted.select("ask_id", "__run", "__all")
    same = recordings.where("run_id is not null").join(F.broadcast(runs) if few else runs, F.col("run_id") == F.col("__run")).where(timeless | none_of("__all"))
    same = same.dropDuplicates(["ask_id", "recording_id"]).join(files, "recording_id")
    columns = ["recording_id", "ask_id", *[c for c in held if c != "recording_id"]]
    return near.select(*columns).unionByName(same.select(*columns))


def describe_recording(recordings: DataFrame, streams: DataFrame, locations: DataFrame, recording_id: str) -> DataFrame:
    """The recording's row with its `streams` in order of name and the name of its `location`; no row if there is none."""
    one = recordings.where(F.col("recording_id") == recording_id).drop("metadata_json")
    own = streams.where(F.col("recording_id") == recording_id).drop("recording_id")
    listed = own.agg(F.sort_array(F.collect_list(F.struct("stream", *[c for c in own.columns if c != "stream"]))).alias("streams"))
    named = locations.select("location_id", F.col("name").alias("location"))
    return one.join(F.broadcast(listed)).join(named, "location_id", "left")
