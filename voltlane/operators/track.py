"""Laps and track segments of runs.

What needs only neighbouring rows (distinct fixes, chords, gate crossings, inside-circle
tests) is native. What depends on all rows before (the glitch guard, the ring of gates) is
a small state machine fed with the few rows that can change its state: one `applyInPandas`
group per run in batch, keyed state in streaming (`voltlane.streaming`), one transition
function for both.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.functions import geo, power
from voltlane.functions.scalar import haversine
from voltlane.operators import metrics
from voltlane.operators.intervals import rows_within
from voltlane.operators.metrics import Guards, by_run
from voltlane.operators.sequence import first_at_or_after

#: A rejected fix counts as real once this many distinct ones agree.
REANCHOR_AFTER = 3
DROPOUT_S, DROPOUT_M = 5.0, 120.0
#: Gates after the next one that a lost reading may skip to.
SKIP = 1
#: Seqs of the smallest blocks by which segments meet their rows; most segments have few rows.
SEGMENT_BLOCK = 16


@dataclass
class LapState:
    """One run's way around the line: the open lap, and the guard against GPS glitches."""

    lap: int = 0
    start_seq: int = 0
    start_ts: float = 0.0
    inside: bool = False
    good: list[float] = field(default_factory=list)  # t, lat, lon of the last accepted fix
    doubt: list[float] = field(default_factory=list)  # the same of the last rejected fix
    streak: int = 0

    def believable(self, t: float, lat: float, lon: float, max_mps: float) -> bool:
        """Whether the fix can follow the accepted ones. Distinct rejects that agree re-anchor the guard."""

        def reachable(since: list[float], slack: float) -> bool:
            d, dt = haversine(since[1], since[2], lat, lon), t - since[0]
            return d <= slack or (dt > 0 and d / dt <= max_mps)

        fix = [t, lat, lon]
        if not self.good or reachable(self.good, 1.0):
            self.good, self.streak = fix, 0
            return True
        if self.doubt and self.doubt[0] == t and haversine(self.doubt[1], self.doubt[2], lat, lon) <= 1.0:
            return False  # the same reading again
        follows = bool(self.doubt) and t > self.doubt[0] and haversine(self.doubt[1], self.doubt[2], lat, lon) / (t - self.doubt[0]) <= max_mps
        self.streak = self.streak + 1 if follows else 1
        if self.streak >= REANCHOR_AFTER:
            self.good, self.doubt, self.streak = fix, [], 0
            return True
        self.doubt = fix
        return False

    def step(self, seq: int, ts: float, t: float, lat: float, lon: float, inside: bool, max_mps: float) -> tuple | None:
        """Feeds one fix; returns (lap_number, start_seq, end_seq, start_ts, end_ts) if it closes a lap."""
        if not self.believable(t, lat, lon, max_mps):
            return None
        closed = None
        if not self.lap:
            self.lap, self.start_seq, self.start_ts = 1, seq, ts
        elif inside and not self.inside:
            closed = (self.lap, self.start_seq, seq, self.start_ts, ts)
            self.lap, self.start_seq, self.start_ts = self.lap + 1, seq, ts
        self.inside = inside
        return closed


LAP_ROWS = "run_id {run}, lap_number long, start_seq long, end_seq long, start_ts double, end_ts double"


def lap_fixes(snapshots: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """The rows that can move a lap's state: fixes that are present, without repeats of one timed reading."""
    key = F.struct("fix_t", "lat", "lon")
    have = snapshots.where("lat is not null and lon is not null")
    again = F.col("fix_t").isNotNull() & F.coalesce(key.eqNullSafe(F.lag(key).over(by_run())), F.lit(False))
    inside = geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius_m
    ts = F.col("ts") if "ts" in snapshots.columns else F.col("t")
    return have.withColumn("__again", again).where("not __again").select("run_id", "seq", ts.alias("ts"), F.coalesce("fix_t", "t").alias("at"), "lat", "lon", inside.alias("inside"))


def lap_intervals(snapshots: DataFrame, lat: float, lon: float, radius_m: float, max_mps: float = 40.0) -> DataFrame:
    """Closed laps of every run. The first accepted fix opens lap 1, wherever it is; entering the circle closes a lap and opens the next."""

    def machine(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = LapState(), []
        for r in rows.sort_values("seq").itertuples(index=False):
            closed = state.step(r.seq, r.ts, r.at, r.lat, r.lon, r.inside, max_mps)
            if closed:
                out.append((r.run_id, *closed))
        return pd.DataFrame(out, columns=["run_id", "lap_number", "start_seq", "end_seq", "start_ts", "end_ts"])

    kind = snapshots.schema["run_id"].dataType.simpleString()
    return lap_fixes(snapshots, lat, lon, radius_m).groupBy("run_id").applyInPandas(machine, LAP_ROWS.format(run=kind))


def lap_edges(snapshots: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """The same without the glitch guard, natively: rising edges of `inside` cut the run."""
    fixes = lap_fixes(snapshots, lat, lon, radius_m)
    w = by_run()
    first = F.row_number().over(w) == 1
    cuts = fixes.withColumn("cut", first | (F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(True)))).where("cut")
    laps = cuts.withColumns({"lap_number": F.row_number().over(w).cast("long"), "end_seq": F.lead("seq").over(w), "end_ts": F.lead("ts").over(w)})
    return laps.where("end_seq is not null").select("run_id", "lap_number", F.col("seq").alias("start_seq"), "end_seq", F.col("ts").alias("start_ts"), "end_ts")


def lap_metrics(snapshots: DataFrame, laps: DataFrame, turns: DataFrame | None = None, guards: Guards = Guards()) -> DataFrame:
    """Laps with their totals (both ends included) and the turns that begin in (start_seq, end_seq]."""
    out = metrics.range_metrics(snapshots, laps, guards)
    if turns is None:
        return out.withColumn("turn_count", F.lit(0).cast("long"))
    inside = rows_within(turns.select("run_id", F.col("start_seq").alias("__at")), laps, at="__at").where("__at > start_seq")
    counts = inside.groupBy("run_id", "lap_number").agg(F.count("*").alias("turn_count"))
    return out.join(counts, ["run_id", "lap_number"], "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0).cast("long")))


@dataclass
class RingState:
    """Which gate of the ring a run crossed last, and that crossing."""

    ordinal: int = -1
    enter: list[float] = field(default_factory=list)

    def step(self, dropout: bool, crossings: dict[int, float], n: int, t0: float, t1: float, extra: list[float]) -> tuple | None:
        """Feeds one pair of fixes; returns (ordinal of the finished segment, entry, exit) if it finishes one.

        crossings: gate -> share of the way. A boundary is [time, share, *extra]."""
        if dropout:
            self.ordinal, self.enter = -1, []
            return None
        lost = self.ordinal < 0
        candidates = range(n) if lost else [(self.ordinal + 1 + k) % n for k in range(SKIP + 1)]
        for gate in candidates:
            if gate in crossings:
                f = crossings[gate]
                boundary = [t0 + f * (t1 - t0), f, *extra]
                done = (self.ordinal, self.enter, boundary) if not lost and gate == (self.ordinal + 1) % n else None
                self.ordinal, self.enter = gate, boundary
                return done
        return None


def to_json(state) -> dict:
    return asdict(state)


def from_json(kind, values: dict):
    return kind(**{f.name: values[f.name] for f in fields(kind)})


def gate_crossings(pairs: DataFrame, gates: DataFrame) -> DataFrame:
    """Pairs of successive fixes (p_lat, p_lon, lat, lon) with the gates they cross and where (ordinal, f).

    A track is one ring of a few dozen gates; its size is checked before it is broadcast."""
    n = gates.count()
    if n > 10_000:
        raise ValueError(f"{n} gates: a track has at most 10000")
    f = geo.crossing_fraction(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"), F.col("gate_lat1"), F.col("gate_lon1"), F.col("gate_lat2"), F.col("gate_lon2"))
    return pairs.join(F.broadcast(gates.select("ordinal", "gate_lat1", "gate_lon1", "gate_lat2", "gate_lon2")), F.lit(True)).withColumn("f", f).where("f is not null")


def fix_pairs(snapshots: DataFrame) -> DataFrame:
    """Distinct valid fixes with the one before: p_t, p_lat, p_lon, at, lat, lon, and whether the step is a dropout."""
    w = by_run()
    at = metrics.distinct_fixes(snapshots).withColumn("at", F.coalesce("fix_t", "t"))
    at = at.withColumns({"p_t": F.lag("at").over(w), "p_lat": F.lag("lat").over(w), "p_lon": F.lag("lon").over(w)}).where("p_t is not null")
    chord = geo.tangent_distance_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    dropout = (F.col("at") - F.col("p_t") > DROPOUT_S) | (chord > DROPOUT_M)
    return at.select("run_id", "seq", "at", "lat", "lon", "p_t", "p_lat", "p_lon", chord.alias("chord_m"), dropout.alias("dropout"))


def ring_events(snapshots: DataFrame, gates: DataFrame) -> DataFrame:
    """The pairs that can change the ring's state: dropouts, and pairs that cross a gate."""
    pairs = fix_pairs(snapshots)
    crossed = gate_crossings(pairs.where("not dropout"), gates).groupBy("run_id", "seq").agg(
        F.first("at").alias("at"), F.first("p_t").alias("p_t"), F.first("chord_m").alias("chord_m"), F.first("dropout").alias("dropout"),
        F.sort_array(F.collect_list(F.struct("ordinal", "f"))).alias("crossings"),
    )
    none = F.array().cast("array<struct<ordinal:int,f:double>>")
    drops = pairs.where("dropout").select("run_id", "seq", "at", "p_t", "chord_m", "dropout", none.alias("crossings"))
    return crossed.select("run_id", "seq", "at", "p_t", "chord_m", "dropout", F.col("crossings").cast(none_type()).alias("crossings")).unionByName(drops)


def none_type() -> str:
    return "array<struct<ordinal:int,f:double>>"


SEGMENT_ROWS = "run_id {run}, ordinal int, enter_t double, enter_f double, enter_seq long, enter_chord double, exit_t double, exit_f double, exit_seq long, exit_chord double"
_SEGMENT_NAMES = [c.split()[0] for c in SEGMENT_ROWS.split(", ")]


def finished(run_id, done: tuple) -> tuple:
    ordinal, enter, leave = done
    row = lambda b: (b[0], b[1], int(b[2]), b[3])
    return (run_id, ordinal, *row(enter), *row(leave))


def ring_step(state: RingState, r, n: int) -> tuple | None:
    crossings = {int(c["ordinal"]): float(c["f"]) for c in r.crossings}
    return state.step(bool(r.dropout), crossings, n, r.p_t, r.at, [float(r.seq), r.chord_m])


def segment_instances(snapshots: DataFrame, gates: DataFrame) -> DataFrame:
    """Finished segments of every run, with the interpolated boundaries."""
    n = gates.count()

    def machine(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = RingState(), []
        for r in rows.sort_values("seq").itertuples(index=False):
            done = ring_step(state, r, n)
            if done:
                out.append(finished(r.run_id, done))
        return pd.DataFrame(out, columns=_SEGMENT_NAMES)

    kind = SEGMENT_ROWS.format(run=snapshots.schema["run_id"].dataType.simpleString())
    if n < 2:
        return snapshots.sparkSession.createDataFrame([], kind)
    return ring_events(snapshots, gates).groupBy("run_id").applyInPandas(machine, kind)


def segment_metrics(snapshots: DataFrame, instances: DataFrame, gates: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """Seqs, speeds, energy, distance and ratios of finished segments.

    Energy is cut at the interpolated crossing times; the sample before the first row counts.
    Distance is the rest of the entry chord, the full steps between, and the exit chord's part."""
    # a handful of rows per lap that several joins below read; without this each would run the machine again
    instances = instances.persist()
    key = ["run_id", "ordinal", "enter_seq", "exit_seq"]
    targets = instances.select("run_id", F.concat_ws(":", "ordinal", "enter_seq", "exit_seq", F.lit("in")).alias("target_id"), F.col("enter_t").alias("target_t"), F.col("enter_seq").alias("around_seq")).unionByName(
        instances.select("run_id", F.concat_ws(":", "ordinal", "enter_seq", "exit_seq", F.lit("out")).alias("target_id"), F.col("exit_t").alias("target_t"), F.col("exit_seq").alias("around_seq"))
    )
    found = first_at_or_after(snapshots, targets).select("run_id", "target_id", "found_seq")
    named = instances.withColumns({"__in": F.concat_ws(":", "ordinal", "enter_seq", "exit_seq", F.lit("in")), "__out": F.concat_ws(":", "ordinal", "enter_seq", "exit_seq", F.lit("out"))})
    starts = found.select("run_id", F.col("target_id").alias("__in"), F.col("found_seq").alias("start_seq"))
    ends = found.select("run_id", F.col("target_id").alias("__out"), F.col("found_seq").alias("end_seq"))
    at = named.join(starts, ["run_id", "__in"]).join(ends, ["run_id", "__out"]).drop("__in", "__out").where("end_seq >= start_seq").persist()
    # energy
    w = by_run()
    steps = snapshots.where("p is not null").select("run_id", "seq", "t", "p", F.lag("seq").over(w).alias("q_seq"), F.lag("t").over(w).alias("q_t"), F.lag("p").over(w).alias("q_p"))
    inside = rows_within(steps, at.withColumn("__from", F.col("start_seq") - 1), "__from", block=SEGMENT_BLOCK)
    kwh = power.clipped_step_kwh(F.col("q_p"), F.col("p"), F.col("q_t"), F.col("t"), F.col("enter_t"), F.col("exit_t"), guards.max_gap_s)
    energy = inside.groupBy(*key).agg(F.when(F.count("*") >= 2, 1000 * F.sum(F.when(F.col("q_seq") >= F.col("start_seq") - 1, kwh).otherwise(0.0))).alias("energy_wh"))
    # distance
    moves = metrics.distance_steps(snapshots, guards).select("run_id", "seq", "step_m")
    between = rows_within(moves, at, "enter_seq", "exit_seq", block=SEGMENT_BLOCK).where("seq > enter_seq and seq < exit_seq")
    middle = between.groupBy(*key).agg(F.sum("step_m").alias("middle_m"))
    chord = lambda c: F.when(F.col(c) <= guards.max_jump_m, F.col(c)).otherwise(0.0)
    out = at.join(energy, key, "left").join(middle, key, "left")
    out = out.withColumn("distance_m", (1 - F.col("enter_f")) * chord("enter_chord") + F.coalesce("middle_m", F.lit(0.0)) + F.col("exit_f") * chord("exit_chord"))
    out = metrics.ratios(out.withColumn("duration_s", F.col("exit_t") - F.col("enter_t")))
    speed = F.coalesce("filtered_speed", "gps_speed") if {"filtered_speed", "gps_speed"} <= set(snapshots.columns) else F.lit(None).cast("double")
    speeds = snapshots.select("run_id", "seq", speed.alias("speed"))
    out = out.join(speeds.select("run_id", F.col("seq").alias("start_seq"), F.col("speed").alias("entry_speed")), ["run_id", "start_seq"], "left")
    out = out.join(speeds.select("run_id", F.col("seq").alias("end_seq"), F.col("speed").alias("exit_speed")), ["run_id", "end_seq"], "left")
    names = gates.select("ordinal", *[c for c in ("segment_id", "kind", "name") if c in gates.columns])
    return out.join(F.broadcast(names), "ordinal").drop("middle_m")
