"""Derived streams against the batch operators: a hostile drive, out of order, in many batches, with restarts."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_telemetry import SNAP, at, drive, gates, payload
from voltlane.functions import geo
from voltlane.operators import ingest, metrics, sequence, track
from voltlane.streaming import derive

MESSAGES = "run_id string, seq long, recv_s double, raw string"


def parts(spark, rows, kind, path, sizes):
    """Writes rows as files of the given sizes, one micro-batch each."""
    k = 0
    for size in sizes:
        if rows[k : k + size]:
            spark.createDataFrame(rows[k : k + size], kind).coalesce(1).write.mode("append").parquet(str(path))
        k += size
    assert k >= len(rows)


def stream(spark, kind, path):
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(path))


def hostile_drive():
    """Two runs around the ring: dropouts, repeated and glitching fixes, zeros and nulls, and rows up to 1.5 s out of order."""
    rng = random.Random(5)
    rows = []
    for run, seconds, skip in (("a", 260, [(40, 45), (130, 142)]), ("b", 150, [])):
        for r in drive(seconds, hz=4, run=run, skip=skip):
            r = list(r)
            if rng.random() < 0.02:
                r[3] = None
            if rng.random() < 0.01:
                r[4] = 0.0
            if rng.random() < 0.005:
                r[4], r[5] = at(4000, 4000)
            rows.append(tuple(r))
    return rows, sorted(rows, key=lambda r: (r[2] + rng.random() * 1.5, r[0]))


def close(a, b):
    return len(a) == len(b) and all(x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(x, float) else x == y for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def test_floats_and_columns_give_the_same_geometry(spark):
    points = [(*at(0, 0), *at(30, 4)), (*at(10, -5), *at(-200, 90)), (*at(0, 0), *at(0, 0))]
    gate = (*at(15, -20), *at(16, 30))
    names = "a double, b double, c double, d double"
    c = spark.createDataFrame(points, names).select(geo.tangent_distance_m(*map(F.col, "abcd")).alias("m"), geo.crossing_fraction(*map(F.col, "abcd"), *map(F.lit, gate)).alias("f")).collect()
    for r, p in zip(c, points, strict=True):
        assert r.m == pytest.approx(geo.tangent_distance_m(*p, math))
        assert r.f == pytest.approx(geo.crossing_share(p[:2], p[2:], gate)) if r.f is not None else geo.crossing_share(p[:2], p[2:], gate) is None


def test_segments_of_a_hostile_drive_equal_batch(spark, tmp_path):
    rows, late_rows = hostile_drive()
    want = sorted(track.segment_instances(spark.createDataFrame(rows, SNAP), gates(spark)).collect())
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    parts(spark, late_rows[:700], SNAP, tmp_path / "in", [250] * 3)
    derive.drain(derive.segments(stream(spark, SNAP, tmp_path / "in"), gates(spark), margin_s=2.0), out, ck)
    early = spark.read.parquet(out).collect()
    assert 0 < len(early) < len(want)
    # a restart from the checkpoint, in a query that stays up: silent runs settle by their timers
    parts(spark, late_rows[700:], SNAP, tmp_path / "in", [250] * 4)
    q = derive.segments(stream(spark, SNAP, tmp_path / "in"), gates(spark), margin_s=2.0, idle_s=4.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            got = sorted(spark.read.parquet(out).collect())
            if len(got) >= len(want):
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert len(want) > 10 and close(got, want)


def test_run_totals_equal_batch_after_every_batch(spark, tmp_path):
    rows, _ = hostile_drive()
    arrived = sorted(rows, key=lambda r: (r[2], r[0]))
    kind, size = SNAP, 400
    for k in range(0, len(arrived), size):
        parts(spark, arrived[k : k + size], kind, tmp_path / "in", [size])
        # each start goes on from the checkpoint of the one before
        derive.upsert_batches(derive.run_totals(stream(spark, kind, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        want = sorted(metrics.run_summary(spark.createDataFrame(arrived[: k + size], kind)).select("run_id", "n_rows", "duration_s", "energy_wh", "distance_m", "efficiency_mi_per_kwh", "avg_speed").collect())
        got = derive.latest(spark, str(tmp_path / "out")).collect()
        assert close(sorted(got), want)


def hostile_messages():
    """A replay at ten times the speed with jitter, a backlog flushed at once, repeats, rejects, a conflict and a clock jump."""
    rng, out = random.Random(3), []
    pub0, recv0 = 1_700_000_000.0, 1_790_000_000.0
    seq = 0
    for k in range(400):
        pub = pub0 + k * 0.02 + (500.0 if k >= 300 else 0.0)
        recv = recv0 + k * 0.002 + rng.uniform(0, 0.004)
        if 150 <= k < 200:
            recv = recv0 + 200 * 0.002
        body = payload("telemetry.v2" if k % 50 == 49 else "telemetry.v1", seq=k // 2 if k == 101 else k, _t_publish_ns=int(pub * 1e9))
        texts = [json.dumps(body)]
        if rng.random() < 0.3:
            texts.append(json.dumps(body | {"_t_publish_ns": int((pub + 0.007) * 1e9)}))
        if k in (20, 120):
            texts.append("{not json")
        if k == 60:
            texts.append(json.dumps(body | {"seq": "60", "_t_publish_ns": int((pub + 0.009) * 1e9)}))
        if k == 61:
            texts.append(json.dumps(body | {"global_ts": 5}))  # same device seq, another body
        for text in texts:
            seq += 1
            out.append(("r" if k % 3 else "q", seq, recv, text))
    return out


def test_ingest_and_clock_equal_batch(spark, tmp_path):
    rows = hostile_messages()
    batch = ingest.examine(spark.createDataFrame(rows, MESSAGES)).withColumn("pub_s", F.col("publish_ns") / 1e9)
    timed = sequence.live_clock(batch.select("run_id", "seq", "recv_s", "pub_s", "raw"))
    want_ts = {(r.run_id, r.seq): (r.ts, r.jump) for r in timed.collect()}
    want = {r.run_id: r for r in ingest.counters(timed.select("run_id", "seq", "ts", "raw"), "telemetry.v1").collect()}
    for half in (rows[:300], rows[300:]):
        parts(spark, half, MESSAGES, tmp_path / "in", [100] * 4)
        derive.drain(derive.ingested(stream(spark, MESSAGES, tmp_path / "in"), "telemetry.v1"), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        ts, jump = want_ts[r.run_id, r.seq]
        assert r.ts == pytest.approx(ts, abs=1e-4) and r.jump == jump
    assert sum(r.jump for r in got) == 2
    for r in derive.counters(out).collect():
        w = want[r.run_id]
        for c in ("seen", "stored", "duplicate", "rejected", "seq_conflicts"):
            assert r[c] == w[c], (r.run_id, c)
        assert r.first_ts == pytest.approx(w.first_ts, abs=1e-4) and r.last_ts == pytest.approx(w.last_ts, abs=1e-4)
        assert [(x.seq, x.reason) for x in r.rejects] == [(x.seq, x.reason) for x in w.rejects]
    assert sum(r.duplicate for r in want.values()) > 50 and sum(r.seq_conflicts for r in want.values()) >= 1


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    rows = drive(20, hz=2)
    parts(spark, rows[10:], SNAP, tmp_path / "in", [100])
    parts(spark, rows[:10], SNAP, tmp_path / "in", [100])
    derive.upsert_batches(derive.run_totals(stream(spark, SNAP, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "order").load(str(tmp_path / "ck")).selectExpr("value.late").collect()
    assert sum(r.late for r in state) == 10
    assert derive.latest(spark, str(tmp_path / "out")).first().n_rows == len(rows) - 10
