"""Run and interval totals over snapshots, as windows and aggregates.

A snapshot has run_id, seq, t (seconds) and, where present, p (kW), lat, lon and fix_t.
`seq` is arrival order and is the only order that counts: nothing here sorts by time.
Runs are the windows' partitions: a run is one recording, so its size does not grow with
the number of runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.functions import geo, power
from voltlane.operators.intervals import rows_within


@dataclass(frozen=True)
class Guards:
    """Steps beyond these are gaps, jumps or glitches. The defaults are those of the car's data."""

    max_gap_s: float = 5.0
    max_jump_m: float = 200.0
    max_mps: float = 40.0


def by_run(*order: str):
    return Window.partitionBy("run_id").orderBy(*(order or ("seq",)))


def power_steps(snapshots: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """Snapshots with power, each with the energy of the step from the one with power before it."""
    w = by_run()
    have = snapshots.where("p is not null")
    have = have.withColumns({"t_before": F.lag("t").over(w), "p_before": F.lag("p").over(w)})
    return have.withColumn("step_kwh", F.coalesce(power.step_kwh(F.col("p_before"), F.col("p"), F.col("t_before"), F.col("t"), guards.max_gap_s), F.lit(0.0)))


def distinct_fixes(snapshots: DataFrame) -> DataFrame:
    """Valid fixes that differ from the valid fix before them (a reading repeated by many snapshots is one)."""
    key = F.struct("fix_t", "lat", "lon")
    have = snapshots.where(geo.valid_fix(F.col("lat"), F.col("lon")))
    again = F.coalesce(key.eqNullSafe(F.lag(key).over(by_run())), F.lit(False))
    return have.withColumn("__again", again).where("not __again").drop("__again")


def distance_steps(snapshots: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """Distinct fixes, each with the metres of the step from the one before it."""
    w = by_run()
    at = distinct_fixes(snapshots).withColumn("fix_at", F.coalesce("fix_t", "t"))
    at = at.withColumns({"fix_before": F.lag("fix_at").over(w), "lat_before": F.lag("lat").over(w), "lon_before": F.lag("lon").over(w)})
    d = geo.tangent_distance_m(F.col("lat_before"), F.col("lon_before"), F.col("lat"), F.col("lon"))
    at = at.withColumn("chord_m", d)
    step = power.step_m(F.col("chord_m"), F.col("fix_at") - F.col("fix_before"), guards.max_gap_s, guards.max_jump_m, guards.max_mps)
    return at.withColumn("step_m", F.coalesce(step, F.lit(0.0)))


def ratios(totals: DataFrame) -> DataFrame:
    return totals.withColumns({
        "efficiency_mi_per_kwh": power.efficiency_mi_per_kwh(F.col("distance_m"), F.col("energy_wh")),
        "avg_speed": F.when(F.col("duration_s") > 0, F.col("distance_m") / F.col("duration_s")),
    })


def all_steps(snapshots: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """Snapshots with step_kwh (null without power), is_fix (a new valid reading) and step_m, in one pass.

    What lag would need filters for comes from the last non-null value before the row, so
    one exchange and one sort by run serve energy and distance alike."""
    before = by_run().rowsBetween(Window.unboundedPreceding, -1)
    valid, key = geo.valid_fix(F.col("lat"), F.col("lon")), F.struct("fix_t", "lat", "lon")
    s = snapshots.withColumns({
        "__power": F.last(F.when(F.col("p").isNotNull(), F.struct("t", "p", "seq")), True).over(before),
        "__key": F.last(F.when(valid, F.struct("fix_t", "lat", "lon", "seq")), True).over(before),
        "has_fix": valid,
    })
    same = F.struct("__key.fix_t", "__key.lat", "__key.lon")
    s = s.withColumn("is_fix", valid & (F.col("__key").isNull() | ~key.eqNullSafe(same)))
    at = F.coalesce("fix_t", "t")
    s = s.withColumn("__fix", F.last(F.when(F.col("is_fix"), F.struct(at.alias("at"), "lat", "lon", "seq")), True).over(before))
    s = s.withColumn("__chord", F.when(F.col("is_fix"), geo.tangent_distance_m(F.col("__fix.lat"), F.col("__fix.lon"), F.col("lat"), F.col("lon"))))
    kwh = power.step_kwh(F.col("__power.p"), F.col("p"), F.col("__power.t"), F.col("t"), guards.max_gap_s)
    metres = power.step_m(F.col("__chord"), at - F.col("__fix.at"), guards.max_gap_s, guards.max_jump_m, guards.max_mps)
    s = s.withColumn("step_kwh", F.when(F.col("p").isNotNull(), F.coalesce(kwh, F.lit(0.0)))).withColumn("step_m", F.when(F.col("is_fix"), F.coalesce(metres, F.lit(0.0))))
    # for sums over parts of a run: the seqs of the readings before, and where a row's own fix first appeared
    s = s.withColumns({"power_before": F.col("__power.seq"), "fix_before": F.when(F.col("is_fix"), F.col("__key.seq")), "fix_first": F.when(F.col("is_fix"), F.col("seq")).otherwise(F.col("__fix.seq"))})
    return s.drop("__power", "__key", "__fix", "__chord")


def run_summary(snapshots: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """Energy, distance, duration, efficiency and speed of each run.

    Energy needs two power readings, distance two fixes, duration two snapshots. The duration
    is last minus first by seq, whatever the clock did in between."""
    return ratios(all_steps(snapshots, guards).groupBy("run_id").agg(
        F.count("*").alias("n_rows"),
        F.when(F.count("*") >= 2, F.max_by("t", "seq") - F.min_by("t", "seq")).alias("duration_s"),
        F.when(F.count("step_kwh") >= 2, F.sum("step_kwh") * 1000).alias("energy_wh"),
        F.when(F.count_if("is_fix") >= 2, F.sum("step_m")).alias("distance_m"),
    ))


def range_metrics(snapshots: DataFrame, intervals: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """The same totals for the snapshots of each interval (run_id, interval columns, start_seq, end_seq; both ends included).

    Steps inside an interval are those whose both ends are inside, so each side's step is
    computed once per run and summed where its earlier end is not before the interval."""
    keys = intervals.columns
    rows = all_steps(snapshots, guards).select("run_id", "seq", "t", "step_kwh", "step_m", "has_fix", "is_fix", "power_before", "fix_before", "fix_first")
    inside = rows_within(rows, intervals)
    kwh = F.sum(F.when(F.col("power_before") >= F.col("start_seq"), F.col("step_kwh")).otherwise(0.0))
    metres = F.sum(F.when(F.col("fix_before") >= F.col("start_seq"), F.col("step_m")).otherwise(0.0))
    # a reading that the interval shares with the rows before it is one fix of the interval too
    shared = F.coalesce(F.max((F.col("has_fix") & (F.col("fix_first") < F.col("start_seq"))).cast("int")), F.lit(0))
    n_fixes = F.count_if("is_fix") + shared
    out = inside.groupBy(*keys).agg(
        F.when(F.count("step_kwh") >= 2, kwh * 1000).alias("energy_wh"),
        F.when(n_fixes >= 2, metres).alias("distance_m"),
        F.when(F.count("*") >= 2, F.max_by("t", "seq") - F.min_by("t", "seq")).alias("duration_s"),
    )
    return ratios(out)
