"""Derived streams with typed state: ring segments, run totals, and ingest with its clock.

Each is a `transformWithState` processor keyed by run. Rows wait in a list state until they
are `margin_s` older than their run's newest row, then settle in order of `seq`, the order
of arrival at the car. A run that is silent for `idle_s` settles what still waits, by a
timer, so a stream needs no closing rows. A row that comes after one with a larger seq
has settled is late: it is counted and left out, for its neighbours' steps are made already.

State is in typed columns (RocksDB), so a restart from the checkpoint goes on where it was.
The batch operators give the same rows: `track.segment_instances`, `metrics.run_summary`,
`sequence.live_clock` and `ingest.counters`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from voltlane.functions import geo
from voltlane.functions.power import METERS_PER_MILE
from voltlane.operators import ingest
from voltlane.operators.metrics import Guards
from voltlane.operators.track import DROPOUT_M, DROPOUT_S, SEGMENT_ROWS, RingState, finished

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands each run's rows to `settle` in order of seq. Input rows have seq, at (seconds) and the columns of WAITING."""

    WAITING = ""
    #: Typed state of the subclass: its columns, and their values for a new run.
    STATE, NEW = "", ()

    def __init__(self, margin_s: float, idle_s: float):
        self.margin_s, self.idle_s = margin_s, idle_s
        self.names = [c.split()[0] for c in f"seq long, at double, {self.WAITING}".split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"seq long, at double, {self.WAITING}")
        self.order = handle.getValueState("order", "settled long, newest double, timer long, late long")
        self.state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        settled, newest, timer, late = self.order.get() if self.order.exists() else (None, -math.inf, None, 0)
        wait = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for r in rows:
            if settled is not None and r.seq <= settled:
                late += 1
                continue
            wait.append(tuple(r[n] for n in self.names))
            newest = max(newest, r.at)
        wait.sort(key=lambda r: r[0])
        ready = next((k for k, r in enumerate(wait) if r[1] > newest - self.margin_s), len(wait)) if self.margin_s > 0 else len(wait)
        yield from self.settled(key, wait[:ready])
        if ready:
            settled = wait[ready - 1][0]
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        self.waiting.clear()
        if wait[ready:]:
            self.waiting.put(wait[ready:])
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.idle_s * 1000)
            self.handle.registerTimer(timer)
        self.order.update((settled, newest, timer, late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        settled, newest, _, late = self.order.get()
        wait = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[0]) if self.waiting.exists() else []
        yield from self.settled(key, wait)
        self.waiting.clear()
        self.order.update((wait[-1][0] if wait else settled, newest, None, late))

    def settled(self, key, rows: list[tuple]) -> Iterator[Row]:
        if not rows:
            return
        state, out = self.settle(list(self.state.get()) if self.state.exists() else list(self.NEW), [dict(zip(self.names, r, strict=True)) for r in rows])
        self.state.update(tuple(state))
        yield from (Row(**dict(zip(self.output, (key[0], *values), strict=True))) for values in out)

    def settle(self, state: list, rows: list[dict]) -> tuple[list, Iterable[tuple]]:
        """The state after the rows, and output rows without the run."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def usable(lat: float | None, lon: float | None) -> bool:
    return all(x is not None and math.isfinite(x) and x != 0 for x in (lat, lon))


class Segments(InOrder):
    """The ring of gates: which one a run crossed last, and its last distinct fix."""

    WAITING = "lat double, lon double, fix_t double"
    STATE = "fix_t double, lat double, lon double, at double, ordinal int, enter_t double, enter_f double, enter_seq double, enter_chord double"
    NEW = (None, None, None, None, -1, None, None, None, None)

    def __init__(self, gates: list[tuple[float, float, float, float]], margin_s: float, idle_s: float):
        super().__init__(margin_s, idle_s)
        self.gates = gates

    def settle(self, state, rows):
        fix_t, lat, lon, at, ordinal, *enter = state
        ring, out = RingState(ordinal, [] if enter[0] is None else enter), []
        for r in rows:
            if not usable(r["lat"], r["lon"]) or (r["fix_t"], r["lat"], r["lon"]) == (fix_t, lat, lon):
                continue
            if at is not None:
                t0, p, q, chord = at, (lat, lon), (r["lat"], r["lon"]), geo.tangent_distance_m(lat, lon, r["lat"], r["lon"], math)
                dropout = r["at"] - t0 > DROPOUT_S or chord > DROPOUT_M
                crossed = {} if dropout else {k: f for k, g in enumerate(self.gates) if (f := geo.crossing_share(p, q, g)) is not None}
                done = ring.step(dropout, crossed, len(self.gates), t0, r["at"], [float(r["seq"]), chord]) if dropout or crossed else None
                if done:
                    out.append(finished(None, done)[1:])
            fix_t, lat, lon, at = r["fix_t"], r["lat"], r["lon"], r["at"]
        return [fix_t, lat, lon, at, ring.ordinal, *(ring.enter or [None] * 4)], out


class Totals(InOrder):
    """Sums of a run so far, its last power reading and its last distinct fix; each batch hands on the totals as they are then."""

    WAITING = "t double, p double, lat double, lon double, fix_t double"
    STATE = "n long, first_t double, last_t double, readings long, kwh double, p double, p_t double, fixes long, metres double, fix_t double, lat double, lon double, fix_at double"
    NEW = (0, None, None, 0, 0.0, None, None, 0, 0.0, None, None, None, None)

    def __init__(self, guards: Guards, margin_s: float, idle_s: float):
        super().__init__(margin_s, idle_s)
        self.guards = guards

    def settle(self, state, rows):
        n, first_t, last_t, readings, kwh, p, p_t, fixes, metres, fix_t, lat, lon, fix_at = state
        g = self.guards
        for r in rows:
            t = r["t"]
            n, first_t, last_t = n + 1, t if n == 0 else first_t, t
            if r["p"] is not None:
                if readings and 0 < t - p_t <= g.max_gap_s:
                    kwh += (p + r["p"]) / 2 * (t - p_t) / 3600
                readings, p, p_t = readings + 1, r["p"], t
            if usable(r["lat"], r["lon"]) and (not fixes or (r["fix_t"], r["lat"], r["lon"]) != (fix_t, lat, lon)):
                when = t if r["fix_t"] is None else r["fix_t"]
                if fixes:
                    d, dt = geo.tangent_distance_m(lat, lon, r["lat"], r["lon"], math), when - fix_at
                    if dt <= g.max_gap_s and d <= g.max_jump_m and (d <= 1.0 or (dt > 0 and d / dt <= g.max_mps)):
                        metres += d
                fixes, fix_t, lat, lon, fix_at = fixes + 1, r["fix_t"], r["lat"], r["lon"], when
        duration, wh, m = last_t - first_t if n >= 2 else None, kwh * 1000 if readings >= 2 else None, metres if fixes >= 2 else None
        efficiency = m / METERS_PER_MILE / (wh / 1000) if m is not None and wh is not None and wh > 0 else None
        speed = m / duration if m is not None and duration is not None and duration > 0 else None
        return [n, first_t, last_t, readings, kwh, p, p_t, fixes, metres, fix_t, lat, lon, fix_at], [(n, duration, wh, m, efficiency, speed)]


class Ingest(InOrder):
    """Verdicts and row times of a run's messages: the clock, and repeats and conflicts with the last stored message."""

    WAITING = "recv_s double, raw string, schema string, repeat_key string, publish_ns long, device_seq long, reasons array<string>"
    STATE = "repeat_key string, device_seq long, pub_s double, clock_recv double, clock_ts double"
    NEW = (None, None, None, None, None)

    def __init__(self, schema: str | None, jump_s: float, margin_s: float, idle_s: float):
        super().__init__(margin_s, idle_s)
        self.schema, self.jump_s = schema, jump_s

    def settle(self, state, rows):
        repeat_key, device_seq, pub_s, clock_recv, clock_ts = state
        out = []
        for r in rows:
            ts, jump = r["recv_s"], False
            if r["publish_ns"] is not None:
                stamp = r["publish_ns"] / 1e9
                if pub_s is not None:
                    sent, received = stamp - pub_s, r["recv_s"] - clock_recv
                    jump = abs(sent - received) > self.jump_s
                    ts = clock_ts + (max(received, 0.0) if jump else sent)
                pub_s, clock_recv, clock_ts = stamp, r["recv_s"], ts
            verdict, conflict = "stored", False
            if r["schema"] is None or (self.schema is not None and r["schema"] != self.schema):
                verdict = "rejected"
            elif r["repeat_key"] == repeat_key:
                verdict = "duplicate"
            else:
                conflict = device_seq is not None and r["device_seq"] == device_seq
                repeat_key, device_seq = r["repeat_key"], r["device_seq"]
            out.append((r["seq"], ts, jump, verdict, conflict, r["raw"], r["schema"], r["reasons"]))
        return [repeat_key, device_seq, pub_s, clock_recv, clock_ts], out


def _by_run(rows: DataFrame, processor: InOrder, output: str, mode: str = "append") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = rows.schema["run_id"].dataType.simpleString()
    processor.output = [c.split()[0] for c in output.split(", ")]
    return rows.select("run_id", *processor.names).groupBy("run_id").transformWithState(processor, output.format(run=kind), mode, "processingTime" if processor.margin_s > 0 else "none")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, appending its rows to Parquet; a restart goes on from the checkpoint.

    Rows that wait stay in the state for the next start. While a stream has timers Spark would make batches without
    data for ever, so they are turned off for this run; a query that stays up needs them."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    query.awaitTermination()


def segments(snapshots: DataFrame, gates: DataFrame, margin_s: float = 2.0, idle_s: float = 5.0) -> DataFrame:
    """Finished ring segments of a stream of snapshots (run_id, seq, t, lat, lon, fix_t), as `track.segment_instances` gives them.

    gates: the ring of one track, a few dozen rows, in order of `ordinal`."""
    ring = [tuple(r)[1:] for r in gates.select("ordinal", "gate_lat1", "gate_lon1", "gate_lat2", "gate_lon2").orderBy("ordinal").limit(10_001).collect()]
    if not 2 <= len(ring) <= 10_000:
        raise ValueError(f"{len(ring)} gates: a ring has 2 to 10000")
    return _by_run(snapshots.withColumn("at", F.coalesce("fix_t", "t")), Segments(ring, margin_s, idle_s), SEGMENT_ROWS)


SUMMARY_ROWS = "run_id {run}, n_rows long, duration_s double, energy_wh double, distance_m double, efficiency_mi_per_kwh double, avg_speed double"


def run_totals(snapshots: DataFrame, guards: Guards = Guards(), margin_s: float = 0.0, idle_s: float = 5.0) -> DataFrame:
    """The totals of each run that had rows in a batch, as `metrics.run_summary` gives them for all rows up to then."""
    return _by_run(snapshots.withColumn("at", F.col("t")), Totals(guards, margin_s, idle_s), SUMMARY_ROWS, "update")


INGEST_ROWS = "run_id {run}, seq long, ts double, jump boolean, verdict string, conflict boolean, raw string, schema string, reasons array<string>"


def ingested(messages: DataFrame, schema: str | None = None, jump_s: float = 30.0, margin_s: float = 0.0, idle_s: float = 5.0) -> DataFrame:
    """Each message (run_id, seq, recv_s, raw) of a stream with its row time and verdict: stored, duplicate or rejected.

    schema: the only one to store (None: any that is known)."""
    seen = ingest.examine(messages).withColumns({"device_seq": F.get_json_object("raw", "$.seq").try_cast("long"), "at": F.col("recv_s")})
    return _by_run(seen, Ingest(schema, jump_s, margin_s, idle_s), INGEST_ROWS)


def counters(verdicts: DataFrame) -> DataFrame:
    """Per run what `ingest.counters` gives, from the rows of `ingested`."""
    is_ = lambda v: F.col("verdict") == v
    nth = F.row_number().over(Window.partitionBy("run_id", "verdict").orderBy("seq"))
    v = verdicts.withColumn("__nth", nth)
    reject = F.when(is_("rejected") & (F.col("__nth") <= 5), F.struct("seq", "ts", F.array_join("reasons", "; ").alias("reason")))
    return v.groupBy("run_id").agg(
        F.count("*").alias("seen"), F.count_if(is_("stored")).alias("stored"), F.count_if(is_("duplicate")).alias("duplicate"), F.count_if(is_("rejected")).alias("rejected"), F.count_if("conflict").alias("seq_conflicts"),
        F.min_by("ts", F.when(is_("stored"), F.col("seq"))).alias("first_ts"), F.max_by("ts", F.when(is_("stored"), F.col("seq"))).alias("last_ts"), F.min(reject).alias("first_reject"), F.sort_array(F.collect_list(reject)).alias("rejects"),
    )


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a stream of totals that replace a key's earlier ones. Each batch is a folder of its own, so a batch that is
    repeated after a failure replaces itself; `latest` reads the newest row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, key: str = "run_id") -> DataFrame:
    """The newest row of each key of a table that `upsert_batches` wrote."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("__last")).select(key, "__last.*")
