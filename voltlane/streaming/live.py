"""Live derivation with Structured Streaming: the batch operators' machines as keyed state.

Order within a run is `seq`. A run's rows wait in its state until `margin_s` behind the
run's newest time (each run has a margin of its own; Spark's watermark is one for all and
would drop what is late), then go through the same transition function as in batch. With
`flush` rows (seq null) a run's remaining rows are settled. So a stream that is drained
and flushed gives the rows of the batch operator.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltlane.functions.scalar import haversine
from voltlane.operators.ingest import LOCK_AFTER, SWITCH_AFTER
from voltlane.operators.track import LAP_ROWS, LapState, from_json

STATE = "body string"


def keyed(stream: DataFrame, output: str, step, finish=None) -> DataFrame:
    """Applies step(state dict, rows) -> (state dict, output tuples) to each run's settled rows."""
    names = [c.split()[0] for c in output.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"wait": [], "machine": None}
        wait, flush = held["wait"], False
        for part in batches:
            ends = part["seq"].isna()
            flush |= bool(ends.any())
            wait += json.loads(part[~ends].to_json(orient="records", double_precision=15))
        wait.sort(key=lambda r: r["seq"])
        newest = max((r["at"] for r in wait), default=0.0)
        ready = len(wait) if flush else next((i for i, r in enumerate(wait) if r["at"] > newest - r["margin"]), len(wait))
        machine, out = step(held["machine"], wait[:ready])
        if flush and finish:
            machine, more = finish(machine)
            out += more
        state.update((json.dumps({"wait": wait[ready:], "machine": machine}),))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=names)

    return stream.groupBy("run_id").applyInPandasWithState(update, output, STATE, "append", GroupStateTimeout.NoTimeout)


def laps(fixes: DataFrame, lat: float, lon: float, radius_m: float, max_mps: float = 40.0, margin_s: float = 2.0) -> DataFrame:
    """Laps as they close. fixes: run_id, seq (null: flush), ts, at, lat, lon."""

    def step(machine, rows):
        state = from_json(LapState, machine) if machine else LapState()
        out = []
        for r in rows:
            inside = haversine(r["lat"], r["lon"], lat, lon) <= radius_m
            closed = state.step(int(r["seq"]), r["ts"], r["at"], r["lat"], r["lon"], inside, max_mps)
            out += [closed] if closed else []
        return asdict(state), out

    kind = fixes.schema["run_id"].dataType.simpleString()
    return keyed(fixes.withColumn("margin", F.lit(float(margin_s))), LAP_ROWS.format(run=kind), step)


def judged(machine: dict, messages: list[dict], end: bool = False) -> list[tuple]:
    """(seq, segment, schema, verdict) of what the next messages settle, run of equal schema by run; `machine` goes on.

    A run of another schema than the locked one is pending until it is long enough to lock, or ends."""
    out: list[tuple] = []

    def settle(seqs: list[int], verdict: str) -> None:
        known = machine["locked"] is not None
        out.extend((s, machine["segment"], machine["locked"], verdict if known or verdict == "stored" else "unknown") for s in seqs)

    def lock() -> None:
        machine["locked"], seqs = machine["pending"]
        machine.update(segment=machine["segment"] + 1, pending=None)
        settle(seqs, "stored")

    for schema, group in groupby(messages, key=lambda r: r["schema"]):
        seqs = [int(r["seq"]) for r in group]
        if schema is None and machine["locked"] is None:
            settle(seqs, "unknown")
            continue
        if machine["pending"] and machine["pending"][0] != schema:
            settle(machine["pending"][1], "rejected")
            machine["pending"] = None
        if schema is None or schema == machine["locked"]:
            settle(seqs, "rejected" if schema is None else "stored")
            continue
        machine["pending"] = [schema, (machine["pending"] or [schema, []])[1] + seqs]
        if len(machine["pending"][1]) >= (LOCK_AFTER if machine["locked"] is None else SWITCH_AFTER):
            lock()
    if end and machine["pending"]:
        if machine["locked"] is None:
            lock()
        else:
            settle(machine["pending"][1], "rejected")
            machine["pending"] = None
    return out


def detector(messages: DataFrame) -> DataFrame:
    """Verdicts of the live schema detector. messages: run_id, seq (null: end of stream), at, schema."""
    new = {"locked": None, "segment": 0, "pending": None}

    def step(machine, rows):
        machine = machine or dict(new)
        out = judged(machine, rows)
        return machine, out

    def finish(machine):
        machine = machine or dict(new)
        out = judged(machine, [], end=True)
        return machine, out

    kind = messages.schema["run_id"].dataType.simpleString()
    return keyed(messages.withColumn("margin", F.lit(0.0)), f"run_id {kind}, seq long, segment long, schema string, verdict string", step, finish)


def sessions(rows: DataFrame, gap: str = "60 seconds", late: str = "2 seconds") -> DataFrame:
    """Gap sessions of each run (run_id, time as `event_time`): closed once the watermark passes their end."""
    w = F.session_window("event_time", gap)
    return rows.withWatermark("event_time", late).groupBy("run_id", w).agg(F.count("*").alias("n")).select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, appending its rows to Parquet; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
