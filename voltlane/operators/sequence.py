"""Operators on rows in arrival order within a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.operators.intervals import rows_within
from voltlane.operators.metrics import by_run


def drop_repeats(rows: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """Rows whose key differs from the row right before them; later returns of a key stay."""
    w = Window.partitionBy("run_id").orderBy(order)
    kept = ~key.eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__kept", kept).where("__kept").drop("__kept")


def gap_sessions(rows: DataFrame, gap_s: float = 60.0) -> DataFrame:
    """A session number per row: a new one begins after a silence longer than `gap_s`."""
    w = by_run()
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > gap_s, F.lit(True))
    return rows.withColumn("session", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def reboots(rows: DataFrame, back_s: float = 1.0) -> DataFrame:
    """Marks rows where the device's counter fell and its clock went back by more than `back_s`."""
    w = by_run()
    fell = (F.col("device_seq") < F.lag("device_seq").over(w)) & (F.lag("device_t").over(w) - F.col("device_t") > back_s)
    return rows.withColumn("reboot", F.coalesce(fell, F.lit(False)))


#: Why a session ended, the first that holds counts.
CAUSES = ("bag", "gap", "reboot", "schema")


def sessions(rows: DataFrame, gap_s: float = 60.0, back_s: float = 1.0, holdoff_s: float = 0.0) -> DataFrame:
    """run_id, session, first_seq, last_seq, n and end_reason of a stream's sessions.

    rows: run_id, seq, t (received), bag_id (null: no bag is being recorded), device_seq, device_t, schema (null: unknown).
    A row begins a session if the bag is another one than before (bag), or if, outside a bag, it comes more than `gap_s`
    after the row before (gap), the device's counter and clock went back (reboot), or its schema is another known one
    than the last known one (schema). Reboots within `holdoff_s` of the last one that split are two publishers on one
    topic and do not split. The last session of a run is open."""
    w = by_run()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = rows.withColumns({
        "__first": F.row_number().over(w) == 1,
        "__bag": ~F.col("bag_id").eqNullSafe(F.lag("bag_id").over(w)),
        "__gap": F.coalesce(F.col("bag_id").isNull() & (F.col("t") - F.lag("t").over(w) > gap_s), F.lit(False)),
        "__reboot": F.coalesce((F.col("device_seq") < F.lag("device_seq").over(w)) & (F.lag("device_t").over(w) - F.col("device_t") > back_s), F.lit(False)),
        "__schema": F.coalesce(F.col("schema") != F.last("schema", ignorenulls=True).over(before), F.lit(False)),
    })
    if holdoff_s > 0:
        s = s.join(held_off(s.where("__reboot").select("run_id", "seq", "t"), holdoff_s), ["run_id", "seq"], "left").withColumn("__reboot", F.col("__reboot") & F.coalesce("__splits", F.lit(False))).drop("__splits")
    cause = reduce(lambda c, name: c.when(F.col(f"__{name}"), name), CAUSES[1:], F.when(F.col(f"__{CAUSES[0]}"), CAUSES[0]))
    s = s.withColumn("__cause", F.when(~F.col("__first"), cause))
    s = s.withColumn("session", F.count(F.when(F.col("__first") | F.col("__cause").isNotNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = s.groupBy("run_id", "session").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), F.min_by("__cause", "seq").alias("__cause"))
    ended = F.coalesce(F.lead("__cause").over(Window.partitionBy("run_id").orderBy("session")), F.lit("open"))
    return found.withColumn("end_reason", ended).drop("__cause")


def held_off(reboots: DataFrame, holdoff_s: float) -> DataFrame:
    """run_id, seq, __splits of reboots: whether each is later than `holdoff_s` after the last that split. Only reboots are walked, run by run."""

    def walk(rows):
        rows = rows.sort_values("seq")
        last, out = None, []
        for t in rows["t"]:
            out.append(last is None or t - last > holdoff_s)
            last = t if out[-1] else last
        return rows[["run_id", "seq"]].assign(__splits=out)

    kind = reboots.schema["run_id"].dataType.simpleString()
    return reboots.groupBy("run_id").applyInPandas(walk, f"run_id {kind}, seq long, __splits boolean")


def last_known(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with the last non-null value up to it of every named column, as <name>_last."""
    w = by_run().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"{c}_last": F.last(c, ignorenulls=True).over(w) for c in columns})


def latest_sample(rows: DataFrame, known: list[str]) -> DataFrame:
    """One row per run: its last row by seq, and the last non-null value of the `known` columns."""
    plain = [c for c in rows.columns if c not in ("run_id", *known)]
    return rows.groupBy("run_id").agg(*[F.max_by(c, "seq").alias(c) for c in plain], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in known])


def even_sample(rows: DataFrame, points: int) -> DataFrame:
    """At most `points` rows of each run: every (N/points)-th by position, and always the last."""
    w = Window.partitionBy("run_id")
    at = rows.withColumns({"__at": F.row_number().over(by_run()) - 1, "__n": F.count("*").over(w)})
    # position i is kept if it is floor(k * N / points) for some k < points - 1, or the last one
    k = F.ceil(F.col("__at") * points / F.col("__n"))
    hit = (F.floor(k * F.col("__n") / points) == F.col("__at")) & (k < points - 1)
    return at.where((F.col("__n") <= points) | hit | (F.col("__at") == F.col("__n") - 1)).drop("__at", "__n")


def live_window(rows: DataFrame, seconds: float = 30, points: int = 100, most_seconds: float = 600, most_points: int = 300) -> DataFrame:
    """The last `seconds` of each run (1 to `most_seconds`), thinned to `points` rows (1 to `most_points`)."""
    seconds, points = min(max(seconds, 1), most_seconds), min(max(points, 1), most_points)
    end = F.max("t").over(Window.partitionBy("run_id"))
    return even_sample(rows.withColumn("__end", end).where(F.col("t") >= F.col("__end") - seconds).drop("__end"), points)


def live_clock(rows: DataFrame, jump_s: float = 30.0) -> DataFrame:
    """Row times on the receiver's clock with the publisher's spacing.

    rows: run_id, seq, recv_s, pub_s (null: not stamped). Over stamped rows the time is the
    first receive time plus, step by step, the publish gap, or the receive gap (not below 0)
    where the two disagree by more than `jump_s`. Rows without a stamp keep receive time."""
    w = by_run()
    stamped = rows.where("pub_s is not null").withColumns({
        "d_pub": F.col("pub_s") - F.lag("pub_s").over(w),
        "d_recv": F.col("recv_s") - F.lag("recv_s").over(w),
    })
    jump = F.abs(F.col("d_pub") - F.col("d_recv")) > jump_s
    step = F.when(F.col("d_pub").isNull(), F.col("recv_s")).when(jump, F.greatest(F.col("d_recv"), F.lit(0.0))).otherwise(F.col("d_pub"))
    stamped = stamped.withColumn("ts", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("jump", F.coalesce(jump, F.lit(False)))
    plain = rows.where("pub_s is null").withColumns({"ts": F.col("recv_s"), "jump": F.lit(False)})
    return stamped.drop("d_pub", "d_recv").unionByName(plain)


def loss_gaps(rows: DataFrame, period_s: float, outage_s: float = 2.0, hole_factor: float = 2.5) -> DataFrame:
    """Counts per run of steps back, outages and holes, and of the messages missing in holes, for a fixed period."""
    gap = F.col("pub_s") - F.lag("pub_s").over(by_run())
    steps = rows.where("pub_s is not null").withColumn("gap", gap).where("gap is not null")
    out = F.col("gap") > outage_s
    hole = ~out & (F.col("gap") >= hole_factor * period_s)
    return steps.groupBy("run_id").agg(
        F.count_if(F.col("gap") < 0).alias("backwards"),
        F.count_if(out).alias("outages"),
        F.sum(F.when(out, F.col("gap")).otherwise(0.0)).alias("outage_s"),
        F.count_if(hole).alias("holes"),
        F.sum(F.when(hole, F.greatest(F.lit(1), F.bround(F.col("gap") / period_s).cast("long") - 1)).otherwise(0)).alias("missing"),
        F.max(F.greatest(F.col("gap"), F.lit(0.0))).alias("max_gap_s"),
    )


def lookback_bound(rows: DataFrame, margin_s: float = 2.0, column: str = "t") -> DataFrame:
    """Per run, the last seq whose time is at least `margin_s` before the run's newest time: what may be derived by now."""
    newest = rows.groupBy("run_id").agg(F.max(column).alias("newest"))
    return rows.join(newest, "run_id").groupBy("run_id").agg(F.max(F.when(F.col(column) <= F.col("newest") - margin_s, F.col("seq"))).alias("until_seq"), F.max("seq").alias("last_seq"))


#: Rows that a target is compared with one by one, as a power of two of seqs; further back the lowest times of such stretches decide.
STRETCH_BITS = 6


def first_at_or_after(rows: DataFrame, targets: DataFrame, within: int = 3000) -> DataFrame:
    """Forward as-of: for each target (run_id, target_id, target_t, around_seq) the earliest seq of the unbroken
    stretch ending at around_seq whose times are all >= target_t, at most `within` seqs back; else around_seq.

    The last earlier row is mostly near, so a target meets the rows of its own stretch of seqs first. Those without
    one there meet the lowest times of the stretches before, and then the rows of one or two stretches. So a target
    costs some hundred rows at most, not `within`."""
    stretch = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.lit(STRETCH_BITS))
    key = ["run_id", "target_id", "target_t", "around_seq"]
    # one row per seq with its lowest time and the seq after it
    line = rows.groupBy("run_id", F.col("seq").alias("__seq")).agg(F.min("t").alias("__t"))
    line = line.withColumns({"__next": F.lead("__seq").over(Window.partitionBy("run_id").orderBy("__seq")), "__stretch": stretch("__seq")})
    asked = targets.select(*key).where("target_id is not null and target_t is not null and around_seq is not null").distinct()
    asked = asked.withColumns({"__from": F.col("around_seq") - within + 1, "__own": stretch("around_seq")})
    early = lambda more=F.lit(True): F.max(F.when((F.col("__t") < F.col("target_t")) & more, F.struct("__seq", "__next")))
    inside = F.col("__seq").between(F.col("__from"), F.col("around_seq"))
    # the targets' own stretches
    own = asked.join(line.withColumnRenamed("__stretch", "__own"), ["run_id", "__own"], "left")
    own = own.groupBy(*key, "__from", "__own").agg(early(inside).alias("__early"), F.min(F.when(inside, F.col("__seq"))).alias("__start"))
    # those before: the last with an earlier time, and the first that the reach has rows of
    rest = own.where("__early is null").select(*key, "__from", "__own").withColumns({"__a": stretch("__from"), "__z": F.col("__own") - 1})
    stretches = line.groupBy("run_id", F.col("__stretch").alias("__at")).agg(F.min("__t").alias("__low"), F.max("__seq").alias("__high"))
    met = rows_within(stretches, rest, "__a", "__z", "__at", block=8)
    met = met.groupBy(*key, "__from").agg(F.max(F.when(F.col("__low") < F.col("target_t"), F.col("__at"))).alias("__last"), F.min(F.when(F.col("__high") >= F.col("__from"), F.col("__at"))).alias("__first"))
    met = met.withColumn("__stretch", F.explode(F.array_distinct(F.array("__last", "__first"))))
    far = met.join(line, ["run_id", "__stretch"]).where(inside).groupBy(*key).agg(early(F.col("__stretch") == F.col("__last")).alias("__far"), F.min(F.when(F.col("__stretch") == F.col("__first"), F.col("__seq"))).alias("__far_start"))
    seen = own.join(far, key, "left").withColumn("__early", F.coalesce("__early", "__far"))
    after = F.least(F.coalesce("__early.__next", "around_seq"), F.col("around_seq"))
    seen = seen.withColumn("__found", F.when(F.col("__early").isNotNull(), after).otherwise(F.coalesce("__far_start", "__start")))
    found = seen.groupBy("run_id", "target_id").agg(F.min("__found").alias("found_seq"))
    return targets.join(found, ["run_id", "target_id"], "left").withColumn("found_seq", F.coalesce("found_seq", "around_seq"))
