"""The curated questions about runs, as functions that return data frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.functions.scalar import day_start, normalized
from voltlane.operators import metrics, track
from voltlane.operators.catalog import listing
from voltlane.operators.metrics import Guards


def resolve_segment(segments: DataFrame, text: str, kind: str) -> DataFrame:
    """Segments that a free name means: the same name, else a turn by its one number, else a straight by all its numbers."""
    asked = F.lit(text.strip().lower())
    numbers = F.regexp_extract_all(asked, F.lit(r"\d+"), F.lit(0))
    own = F.regexp_extract_all(F.col("name"), F.lit(r"\d+"), F.lit(0))
    rank = F.when(F.lower("name") == asked, 0).when((F.lit(kind) == "turn") & (F.size(numbers) == 1) & F.array_contains("aliases", F.element_at(numbers, 1)), 1).when((F.lit(kind) == "straight") & (F.size(numbers) > 0) & (own == numbers), 2)
    found = segments.where(F.col("kind") == kind).withColumn("__rank", rank).where("__rank is not null")
    best = found.agg(F.min("__rank").alias("__best"))
    return found.join(F.broadcast(best), F.col("__rank") == F.col("__best")).drop("__rank", "__best")


def occurrence(instances: DataFrame, segments: DataFrame, run_id, text: str, kind: str, which: str = "latest") -> DataFrame:
    """The latest or first time that a run drove a segment, with the speed gained in it."""
    names = resolve_segment(segments, text, kind).select("ordinal")
    mine = instances.where(F.col("run_id") == run_id).join(F.broadcast(names), "ordinal")
    order = F.col("start_seq").desc() if which == "latest" else F.col("start_seq")
    return mine.orderBy(order).limit(1).withColumn("speed_delta", F.col("exit_speed") - F.col("entry_speed"))


def compare_instances(instances: DataFrame, run_id, ordinal: int, limit: int = 10) -> DataFrame:
    """The last `limit` times of one segment, with the fastest exit and the thriftiest marked (earliest first on ties)."""
    last = instances.where((F.col("run_id") == run_id) & (F.col("ordinal") == ordinal)).orderBy(F.desc("start_seq")).limit(limit)
    best = last.agg(
        F.max_by("start_seq", F.when(F.col("exit_speed").isNotNull(), F.struct("exit_speed", -F.col("start_seq")))).alias("fastest"),
        F.max_by("start_seq", F.when(F.col("efficiency_mi_per_kwh").isNotNull(), F.struct("efficiency_mi_per_kwh", -F.col("start_seq")))).alias("thriftiest"),
    )
    return last.join(F.broadcast(best)).withColumns({"is_fastest": F.col("start_seq") == F.col("fastest"), "is_thriftiest": F.col("start_seq") == F.col("thriftiest")}).drop("fastest", "thriftiest")


def one_view(main: DataFrame, live: DataFrame | None) -> DataFrame:
    """Rows of the main and the live store as one table with `tier` (upload or live); a run that is in the live store is
    answered from there alone. Columns that one of them lacks are null."""
    if live is None:
        return main.withColumn("tier", F.lit("upload"))
    here = live.select(F.col("run_id").alias("__live")).distinct()
    rest = main.join(here, F.col("run_id") == F.col("__live"), "left_anti").withColumn("tier", F.lit("upload"))
    return live.withColumn("tier", F.lit("live")).unionByName(rest, allowMissingColumns=True)


def compare_laps(laps: DataFrame, run_id, a: int, b: int, measures: tuple[str, ...] = ("energy_wh", "avg_speed", "duration_s", "distance_m", "efficiency_mi_per_kwh")) -> DataFrame:
    """Two laps of a run (None: of each run) side by side and b - a; null where either is missing."""
    mine = laps if run_id is None else laps.where(F.col("run_id") == run_id)
    filled = mine.withColumn("duration_s", F.coalesce("duration_s", F.col("end_ts") - F.col("start_ts")))
    one, two = (filled.where(F.col("lap_number") == n).select("run_id", *[F.col(m).alias(f"{m}_{s}") for m in (*measures, "turn_count")]) for n, s in ((a, "a"), (b, "b")))
    return one.join(two, "run_id").select("*", *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta") for m in measures])


def list_runs(runs: DataFrame, *, location: str | None = None, category: str | None = None, since: str | float | None = None, until: str | float | None = None, limit: int = 20, include_live_twins: bool = False) -> DataFrame:
    """Runs, those being recorded first, then the newest. A live run whose upload is linked is its twin and left out."""
    if not include_live_twins:
        runs = runs.where((F.col("tier") != "live") | F.col("linked_run_id").isNull())
    if location:
        runs = runs.where(normalized(F.col("location")) == normalized(F.lit(location)))
    start = F.coalesce("start_ts", F.lit(0.0))
    return listing(runs, since=moment(since), until=moment(until, True), time=F.col("start_ts"), equal={"category": category}, order=[F.col("status") != "recording", start.desc(), "run_id"], limit=limit)


def moment(value: str | float | None, end: bool = False) -> Column | None:
    """Epoch seconds of a number, or of a local calendar day (for an end: of the day after)."""
    if value is None:
        return None
    try:
        return F.lit(float(value))
    except ValueError:
        return day_start(F.date_add(F.to_date(F.lit(value)), 1 if end else 0))


def list_track_segments(segments: DataFrame) -> DataFrame:
    """The track's segments in driving order."""
    return segments.select("ordinal", "kind", "name", "aliases", *[c for c in ("length_m",) if c in segments.columns]).orderBy("ordinal")


def reclassify(snapshots: DataFrame, gates: DataFrame, line: tuple[float, float, float], guards: Guards = Guards()) -> dict[str, DataFrame]:
    """All that is derived from raw snapshots, anew: run summary, laps and finished segments with their totals."""
    laps = track.lap_intervals(snapshots, *line)
    segments = track.segment_metrics(snapshots, track.segment_instances(snapshots, gates), gates, guards)
    return {"run_summary": metrics.run_summary(snapshots, guards), "laps": track.lap_metrics(snapshots, laps, segments, guards), "segments": segments}
