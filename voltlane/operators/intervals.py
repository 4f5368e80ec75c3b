"""Interval and spatial joins by equi-joined cells, so that no pair of far-away rows meets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.functions.geo import haversine_m


#: Blocks of one level are so many times as wide as those of the level below; an interval touches FAN + 1 blocks of its level at most.
FAN_BITS = 3
LEVELS = 18


def _level(start: Column, end: Column, block: int) -> Column:
    """The lowest level on which the interval spans no more than FAN blocks."""
    span = end - start
    return reduce(lambda a, b: a + b, ((span >= (block << FAN_BITS * (k + 1))).cast("int") for k in range(LEVELS - 1) if block << FAN_BITS * (k + 1) < 1 << 63))


def _block(at: Column, level: Column, block: int) -> Column:
    """Which block of its level a seq lies in, exactly for all 64-bit seqs."""
    return F.call_function("shiftright", at.cast("long"), F.lit(block.bit_length() - 1) + FAN_BITS * level)


def rows_within(rows: DataFrame, intervals: DataFrame, start: str = "start_seq", end: str = "end_seq", at: str = "seq", block: int = 512) -> DataFrame:
    """Pairs of an interval and a row of its run with start <= at <= end.

    Both sides meet by run, level and block of seqs. An interval goes to the level whose blocks
    (`block` seqs, a power of two, and eight times more on each level above) suit its span, so it
    is cut into nine blocks at most however sparse its seqs are, and reads its own stretch of the
    run only. Rows are dealt to the levels that occur; short intervals have one. Columns of both
    sides stay; rows' run_id goes."""
    if block < 1 or block & (block - 1):
        raise ValueError("block is a power of two")
    cut = intervals.where(F.col(start) <= F.col(end)).withColumn("__level", _level(F.col(start).cast("long"), F.col(end).cast("long"), block))
    levels = cut.agg(F.collect_set("__level").alias("__levels"))  # one row of at most LEVELS numbers
    cut = cut.withColumn("__block", F.explode(F.sequence(_block(F.col(start), F.col("__level"), block), _block(F.col(end), F.col("__level"), block))))
    dealt = rows.withColumnRenamed("run_id", "__run").join(F.broadcast(levels)).withColumn("__on", F.explode("__levels")).drop("__levels")
    dealt = dealt.withColumn("__of", _block(F.col(at), F.col("__on"), block))
    met = cut.join(dealt, (F.col("__run") == F.col("run_id")) & (F.col("__on") == F.col("__level")) & (F.col("__of") == F.col("__block")) & F.col(at).between(F.col(start), F.col(end)))
    return met.drop("__run", "__of", "__block", "__on", "__level")


def disjoint(intervals: DataFrame, name: str) -> DataFrame:
    """Half-open pieces (run_id, start_seq, end_seq, name) of intervals that may overlap: of those over a piece the one that starts last counts."""
    ends = intervals.select("run_id", F.explode(F.array("start_seq", "end_seq")).alias("seq")).distinct()
    pieces = ends.withColumn("__next", F.lead("seq").over(Window.partitionBy("run_id").orderBy("seq"))).where("__next is not null")
    whole = intervals.where("end_seq > start_seq").select("run_id", F.col("start_seq").alias("__s"), (F.col("end_seq") - 1).alias("__e"), F.col(name).alias("__name"))
    # an interval covers a piece if it covers the piece's first seq
    held = rows_within(pieces, whole, "__s", "__e")
    return held.groupBy("run_id", "seq", "__next").agg(F.max_by("__name", F.struct("__s", -F.col("__e"))).alias(name)).select("run_id", F.col("seq").alias("start_seq"), F.col("__next").alias("end_seq"), name)


def interval_of(rows: DataFrame, intervals: DataFrame, name: str, at: str = "seq") -> DataFrame:
    """Each row with the `name` of the half-open interval [start_seq, end_seq) of its run that holds it, or null.

    Interval starts join the rows' stream as events; the last start up to a row is its
    candidate, whose end is then checked. One sort per run, no pairs. Where intervals
    overlap or lie within each other the one that starts last is taken."""
    intervals = disjoint(intervals, name)
    starts = intervals.select("run_id", F.col("start_seq").alias(at), F.struct(F.col("start_seq").alias("s"), F.col("end_seq").alias("e"), F.col(name).alias("n")).alias("__open"))
    both = rows.withColumn("__row", F.lit(1)).unionByName(starts.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("run_id").orderBy(at, "__row", F.col("__open.e").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last("__open", ignorenulls=True).over(w)).where("__row = 1")
    return seen.withColumn(name, F.when(F.col(at) < F.col("__last.e"), F.col("__last.n"))).drop("__row", "__open", "__last")


def overlap_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of intervals (a_id, a_start, a_end) and (b_id, b_start, b_end) that overlap by more than a point.

    Both sides are cut into cells of width `cell` and joined on the cell; a pair is
    kept in the first cell that both touch, so it comes once."""
    cells = lambda s, e: F.sequence(F.floor(F.col(s) / cell), F.floor(F.col(e) / cell))
    left = a.withColumn("__cell", F.explode(cells("a_start", "a_end")))
    right = b.withColumn("__cell", F.explode(cells("b_start", "b_end")))
    met = left.join(right, "__cell").where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return met.where(F.col("__cell") == F.floor(F.greatest("a_start", "b_start") / cell)).drop("__cell")


def overlap_fraction():
    """Shared length over the shorter interval's length."""
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return shared / F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))


def _back(a: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `a` with what was found for their span (__s, __e)."""
    return a.join(found, (F.col("a_start") == F.col("__s")) & (F.col("a_end") == F.col("__e"))).drop("__s", "__e")


def best_overlap(a: DataFrame, b: DataFrame, cell: float, over: float = 0.5) -> DataFrame:
    """For each a the b with the largest overlap fraction above `over`; ties go to the smallest b_id.

    Equal spans are one in the join, with their smallest b_id: pairs follow the different spans, not the rows."""
    spans, firsts = a.select("a_start", "a_end").distinct(), b.groupBy("b_start", "b_end").agg(F.min("b_id").alias("b_id"))
    pairs = overlap_pairs(spans, firsts, cell).withColumn("fraction", overlap_fraction()).where(F.col("fraction") > over)
    best = lambda: F.max_by(F.struct("b_id", "fraction"), F.struct("fraction", -F.col("b_id")))
    found = pairs.groupBy(F.col("a_start").alias("__s"), F.col("a_end").alias("__e")).agg(best().alias("m")).select("__s", "__e", "m.b_id", "m.fraction")
    return _back(a, found).groupBy("a_id").agg(best().alias("m")).select("a_id", "m.b_id", "m.fraction")


def overlap_counts(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """a_id and n, with how many b it overlaps by more than a point; those with none are left out. Equal spans are one in the join."""
    spans, many = a.select("a_start", "a_end").distinct(), b.groupBy("b_start", "b_end").agg(F.count("*").alias("__many"))
    found = overlap_pairs(spans, many, cell).groupBy(F.col("a_start").alias("__s"), F.col("a_end").alias("__e")).agg(F.sum("__many").alias("__n"))
    return _back(a, found).groupBy("a_id").agg(F.sum("__n").alias("n"))


def nearest_within(points: DataFrame, places: DataFrame) -> DataFrame:
    """Each point (point_id, lat, lon) with the nearest place (place_id, p_lat, p_lon, radius_m) within that place's radius.

    Places are listed under every grid cell that their circle touches, points under
    their own; they join on the cell. Columns of cells are counted around the earth, so circles
    reach over the date line. Ties go to the smallest place_id."""
    size, around = 0.01, 36_000  # degrees (about 1.1 km north to south), and cells of a whole circle
    north = F.col("radius_m") / 110_000
    east = north / F.greatest(F.cos(F.radians(F.abs("p_lat") + north)), F.lit(0.01))
    span = lambda c, r: F.sequence(F.floor((F.col(c) - r) / size), F.floor((F.col(c) + r) / size))
    turned = F.array_distinct(F.transform(span("p_lon", F.least(east, F.lit(180.0))), lambda x: F.pmod(x, F.lit(around))))
    cells = places.withColumn("__y", F.explode(span("p_lat", north))).withColumn("__x", F.explode(turned))
    at = points.withColumns({"__y": F.floor(F.col("lat") / size), "__x": F.pmod(F.floor(F.col("lon") / size), F.lit(around))})
    met = at.join(cells, ["__y", "__x"]).withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    found = met.where("distance_m <= radius_m").groupBy("point_id").agg(F.min(F.struct("distance_m", "place_id")).alias("m"))
    return points.join(found, "point_id", "left").select(*points.columns, F.col("m.place_id").alias("place_id"), F.col("m.distance_m").alias("distance_m"))
