import json
import math
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from voltlane.functions import geo, power
from voltlane.functions.payload import GROUPS, SCHEMAS, examine, shape
from voltlane.operators import ingest, metrics, sequence, tools, track
from voltlane.operators.metrics import Guards
from voltlane.sources import recordings, sinks
from voltlane.streaming import live

SNAP = "run_id string, seq long, t double, p double, lat double, lon double, fix_t double"
LAT, LON, M = 42.0, -76.0, 111_320.0


def at(x, y):
    return LAT + y / M, LON + x / (M * math.cos(math.radians(LAT)))


def ring(s):
    """The point after s metres around a 300 m by 150 m rectangle."""
    s %= 900
    if s < 300:
        return s, 0.0
    if s < 450:
        return 300.0, s - 300
    if s < 750:
        return 750 - s, 150.0
    return 0.0, 900 - s


CUTS = [0.5 + 150 * k for k in range(6)]


def gates(spark):
    rows = []
    for k, c in enumerate(CUTS):
        (x0, y0), (x1, y1) = ring(c - 0.4), ring(c + 0.4)
        d = math.hypot(x1 - x0, y1 - y0)
        nx, ny, (x, y) = -(y1 - y0) / d, (x1 - x0) / d, ring(c)
        rows.append((k, k + 1, "turn" if k % 2 else "straight", f"Segment {k}", *at(x - 40 * nx, y - 40 * ny), *at(x + 40 * nx, y + 40 * ny)))
    return spark.createDataFrame(rows, "ordinal int, segment_id int, kind string, name string, gate_lat1 double, gate_lon1 double, gate_lat2 double, gate_lon2 double")


def drive(seconds, hz=10, mps=10.0, start=60.0, kw=0.5, run="r", skip=()):
    """Snapshots at `hz`, a fix each second that the snapshots repeat, constant speed and power."""
    rows = []
    for i in range(seconds * hz + 1):
        t = 1000 + i / hz
        s = float(int(i / hz))
        lat, lon = (None, None) if any(a <= s < b for a, b in skip) else at(*ring(start + mps * s))
        rows.append((run, i + 1, t, kw, lat, lon, None if lat is None else 1000 + s))
    return rows


def test_run_summary_of_a_constant_drive(spark):
    s = metrics.run_summary(spark.createDataFrame(drive(60), SNAP)).first()
    assert s["duration_s"] == pytest.approx(60) and s["energy_wh"] == pytest.approx(500 * 60 / 3600)
    assert s["distance_m"] == pytest.approx(600, rel=0.02)
    assert s["efficiency_mi_per_kwh"] == pytest.approx((s["distance_m"] / 1609.344) / (s["energy_wh"] / 1000))
    assert s["avg_speed"] == pytest.approx(s["distance_m"] / 60)


def test_guards_and_missing_readings(spark):
    rows = [("r", 1, 0.0, 1.0, *at(0, 0), 0.0), ("r", 2, 10.0, 1.0, *at(10, 0), 1.0), ("r", 3, 12.0, 1.0, *at(5000, 0), 2.0), ("r", 4, 12.0, None, 0.0, LON, 3.0), ("r", 5, 13.0, 1.0, *at(5001, 0), 4.0)]
    s = metrics.run_summary(spark.createDataFrame(rows, SNAP)).first()
    assert s["energy_wh"] == pytest.approx(1000 * 3 / 3600)  # ten seconds are a gap; 10-12 and 12-13 count
    assert s["distance_m"] == pytest.approx(11, abs=0.2)  # the jump does not count
    one = metrics.run_summary(spark.createDataFrame([("r", 1, 0.0, 1.0, *at(0, 0), 0.0)], SNAP)).first()
    assert one["energy_wh"] is None and one["distance_m"] is None and one["duration_s"] is None
    assert metrics.run_summary(spark.createDataFrame([], SNAP)).count() == 0


def test_formulas(spark):
    c = lambda *v: [F.lit(x) for x in v]
    row = spark.range(1).select(
        geo.haversine_m(*c(LAT, LON, *at(0, 100))).alias("h"), geo.tangent_distance_m(*c(LAT, LON, *at(100, 0))).alias("d"), power.power_kw(*c(-3.0, 48.0)).alias("neg"), power.power_kw(F.lit(None).cast("double"), F.lit(4.0)).alias("none"),
        power.efficiency_mi_per_kwh(*c(1609.344, 500.0)).alias("e"), power.efficiency_mi_per_kwh(*c(1.0, 0.0)).alias("e0"), geo.valid_fix(F.lit(0.0), F.lit(1.0)).alias("v0"), geo.valid_fix(F.lit(float("nan")), F.lit(1.0)).alias("vn"), geo.valid_fix(*c(1.0, 1.0)).alias("v1"),
        geo.crossing_fraction(*c(*at(0, 0), *at(10, 0), *at(4, -5), *at(4, 5))).alias("f"), geo.crossing_fraction(*c(*at(0, 0), *at(3, 0), *at(4, -5), *at(4, 5))).alias("short"), geo.crossing_fraction(*c(*at(0, 0), *at(0, 9), *at(4, -5), *at(4, 5))).alias("parallel"),
    ).first()
    assert row["h"] == pytest.approx(100, rel=0.01) and row["d"] == pytest.approx(100, rel=0.01)
    assert (row["neg"], row["none"], row["e"], row["e0"]) == (0.0, None, 2.0, None)
    assert (row["v0"], row["vn"], row["v1"]) == (False, False, True)
    assert row["f"] == pytest.approx(0.4, abs=1e-6) and row["short"] is None and row["parallel"] is None


def test_segments_around_the_ring(spark):
    s, g = spark.createDataFrame(drive(150), SNAP).withColumns({"filtered_speed": F.lit(10.0), "gps_speed": F.lit(9.0)}), gates(spark)
    found = track.segment_metrics(s, track.segment_instances(s, g), g).orderBy("start_seq").collect()
    assert [r["ordinal"] for r in found[:6]] == [1, 2, 3, 4, 5, 0]
    for r in found:
        assert r["duration_s"] == pytest.approx(15, abs=0.2)
        assert r["distance_m"] == pytest.approx(150, rel=0.03)
        assert r["energy_wh"] == pytest.approx(500 * r["duration_s"] / 3600, rel=0.01)
        assert r["entry_speed"] == 10.0


def test_a_dropout_leaves_no_guess(spark):
    s, g = spark.createDataFrame(drive(150, skip=[(30, 42)]), SNAP), gates(spark)
    found = [r["ordinal"] for r in track.segment_instances(s, g).orderBy("exit_t").collect()]
    whole = [r["ordinal"] for r in track.segment_instances(spark.createDataFrame(drive(150), SNAP), g).orderBy("exit_t").collect()]
    assert 0 < len(found) < len(whole)
    back = spark.createDataFrame(drive(150, mps=-10.0), SNAP)
    assert track.segment_instances(back, g).count() == 0  # driven backwards, no gate is the next one
    assert track.segment_instances(s, g.limit(1)).count() == 0


def test_laps_open_with_the_first_fix_and_survive_a_glitch(spark):
    rows = drive(200)
    bad = [list(r) for r in rows]
    for r in bad:
        if 1050 <= r[2] < 1051:
            r[4], r[5] = at(0, 0)  # one reading at the line: a glitch
    for data in (rows, [tuple(r) for r in bad]):
        s = spark.createDataFrame(data, SNAP)
        laps = track.lap_intervals(s, *at(0, 0), 25.0).orderBy("lap_number").collect()
        assert [r["lap_number"] for r in laps] == [1, 2]
        assert laps[0]["start_seq"] == 1 and laps[1]["end_ts"] - laps[1]["start_ts"] == pytest.approx(90, abs=2)
    m = track.lap_metrics(s, track.lap_intervals(s, *at(0, 0), 25.0)).orderBy("lap_number").collect()
    assert m[1]["distance_m"] == pytest.approx(900, rel=0.05)
    edges = track.lap_edges(spark.createDataFrame(rows, SNAP), *at(0, 0), 25.0).count()
    assert edges == 2


def test_streamed_laps_equal_batch(spark, tmp_path):
    rows = drive(300, hz=2)
    s = spark.createDataFrame(rows, SNAP)
    want = track.lap_intervals(s, *at(0, 0), 25.0).orderBy("lap_number").collect()
    fixes = track.lap_fixes(s, *at(0, 0), 25.0).drop("inside").orderBy("seq").collect()
    kind = "run_id string, seq long, ts double, at double, lat double, lon double"
    for k in range(0, len(fixes), 97):
        spark.createDataFrame(fixes[k : k + 97], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("r", None, None, None, None, None)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.drain(live.laps(stream, *at(0, 0), 25.0), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("lap_number").collect()
    assert got == want and len(got) == 3


def test_streamed_sessions(spark, tmp_path):
    times = [0, 10, 50, 200, 220, 1000, 5000]
    df = spark.createDataFrame([("r", t) for t in times], "run_id string, t long").select("run_id", F.timestamp_seconds("t").alias("event_time"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live.drain(live.sessions(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def payload(schema="telemetry.v1", seq=1, **over):
    control, errors = SCHEMAS[schema]
    p = {"seq": seq, "global_ts": 1_000_000 + seq * 1000, "_t_publish_ns": 1_700_000_000_000_000_000 + seq} | {g: {"ts": 0} | dict.fromkeys(n, 1.5) for g, n in GROUPS.items()}
    p |= {"motor": {"ts": 0, "rpm": 0, control: 0}, "filtered": {"speed": 5}} | ({"errcount": 0} if errors else {})
    return p | over


def test_strict_shapes_are_disjoint():
    for s in SCHEMAS:
        x = examine(json.dumps(payload(s)))
        assert x["schema"] == s and not x["reasons"]
        assert set(shape(s)) == set(payload(s))
    for bad in (payload() | {"seq": "1"}, payload(extra=1), payload() | {"seq": True}, payload(filtered={"speed": None}), payload(filtered={}), payload(gps=[1]), [1], 3):
        x = examine(json.dumps(bad))
        assert x["schema"] is None and 0 < len(x["reasons"]) <= 5
    assert examine("{")["reasons"] == ["not JSON"] and examine(None)["schema"] is None
    assert examine(json.dumps(payload(filtered={"speed": float("nan")})))["schema"] == "telemetry.v1"


MESSAGE = "run_id string, seq long, ts double, raw string"


def test_ingest_drops_repeats_and_maps_groups(spark):
    nan = dict.fromkeys(("lat", "long", "heading", "speed"), float("nan"))
    raws = [payload(seq=1), payload(seq=1) | {"_t_publish_ns": 5}, "junk", payload(seq=1), payload(seq=1, filtered={"speed": 6}), payload(seq=2, gps={"ts": 0, **nan}), payload(seq=1)]
    m = spark.createDataFrame([("r", i, float(i), r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], MESSAGE)
    rows = ingest.snapshots(m, "telemetry.v1").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [0, 4, 5, 6]
    assert rows[2]["gps"] is None and rows[0]["gps"]["lon"] == 1.5 and rows[0]["errcount"] is None and rows[1]["filtered_speed"] == 6.0
    c = ingest.counters(m, "telemetry.v1").first()
    assert (c["seen"], c["stored"], c["duplicate"], c["rejected"], c["seq_conflicts"]) == (7, 4, 2, 1, 1)
    assert c["first_reject"]["reason"] == "not JSON"
    d = ingest.detect(m.where("seq <> 2")).first()
    assert d["schema"] == "telemetry.v1" and ingest.detect(m).first()["schema"] is None


def test_detector_locks_switches_and_rejects_short_runs(spark, tmp_path):
    kinds = ["a"] * 25 + ["b"] * 5 + ["a"] * 3 + [None] + ["b"] * 22 + ["a"] * 2
    df = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)], "run_id string, seq long, schema string")
    rows = sorted((r["seq"], r["segment"], r["verdict"]) for r in ingest.live_detect(df).collect())
    assert [r[0] for r in rows] == list(range(len(kinds)))
    assert {r[2] for r in rows[:25]} == {"stored"} and {r[2] for r in rows[25:30]} == {"rejected"} and rows[33][2] == "rejected"
    assert {r[1:] for r in rows[34:56]} == {(2, "stored")} and {r[2] for r in rows[56:]} == {"rejected"}
    src = df.withColumn("at", F.col("seq").cast("double"))
    parts = [src.where(F.col("seq") % 3 == k) for k in (0, 1, 2)]  # all in one batch, out of order
    parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(spark.createDataFrame([("r", None, None, None)], src.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    live.drain(live.detector(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r["seq"], r["segment"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == rows


def plain_verdicts(kinds):
    """The detector's verdicts by going through the messages one by one."""
    locked, segment, held, out = None, 0, [], {}
    for i, k in [*enumerate(kinds), (None, "end")]:
        if held and (i is None or (k != kinds[held[-1]] and (k is not None or locked))):
            if i is None and locked is None:
                locked, segment = kinds[held[-1]], 1
                out |= {h: (1, locked, "stored") for h in held}
            else:
                out |= {h: (segment, locked, "rejected" if locked else "unknown") for h in held}
            held = []
        if i is None:
            break
        if k is not None and k != locked:
            held.append(i)
            if len(held) == 20:
                locked, segment = k, segment + 1
                out |= {h: (segment, k, "stored") for h in held}
                held = []
        else:
            out[i] = (segment, locked, "stored" if k else "rejected" if locked else "unknown")
    return [(i, *out[i]) for i in range(len(kinds))]


def test_detector_matches_a_walk_over_the_messages(spark):
    rng = random.Random(9)
    runs = [[k for _ in range(rng.randrange(1, 9)) for k in [rng.choice(["a", "b", None])] * rng.choice([1, 2, 5, 19, 20, 21, 40])] for _ in range(40)] + [[None] * 3, ["a"] * 3 + [None] + ["b"] * 2, ["a"] * 19 + [None] + ["a"]]
    df = spark.createDataFrame([(r, i, k) for r, kinds in enumerate(runs) for i, k in enumerate(kinds)], "run_id long, seq long, schema string")
    got = ingest.live_detect(df).orderBy("run_id", "seq").collect()
    for r, kinds in enumerate(runs):
        want = plain_verdicts(kinds)
        assert [tuple(x)[1:] for x in got if x["run_id"] == r] == want, kinds
        machine, out, at = {"locked": None, "segment": 0, "pending": None}, [], 0
        while at < len(kinds):
            step = rng.randrange(1, 30)
            out += live.judged(machine, [{"seq": i, "schema": kinds[i]} for i in range(at, min(at + step, len(kinds)))])
            at += step
        assert sorted(out + live.judged(machine, [], end=True)) == want


def plain_losses(times, outage=2.0):
    """The loss meter, one gap after the other."""
    recent, taken, period, holes, missing, outages, total, back = [], 0, None, 0, 0, 0, 0.0, 0
    for a, b in zip(times, times[1:], strict=False):
        g = b - a
        if g < 0:
            back += 1
        elif g > outage:
            outages, total = outages + 1, total + g
        elif period is not None and g >= 2.5 * period:
            holes, missing = holes + 1, missing + max(1, round(g / period) - 1)
        else:
            recent, taken = [*recent, g][-101:], taken + 1
            if taken == 11 or (taken > 11 and taken % 10 == 0):
                period = sorted(recent)[len(recent) // 2]
    return period, missing, holes, outages, pytest.approx(total), back


def test_loss_meter_matches_a_walk_over_the_gaps(spark):
    rng, rows, want = random.Random(4), [], {}
    for run in range(12):
        t, times = 100.0, []
        for _ in range(rng.choice([1, 5, 12, 300, 900])):
            times.append(t)
            t += rng.choice([0.02, 0.02, 0.021, 0.019, 0.04]) if rng.random() < 0.9 else rng.choice([0.1, 0.5, 5.0, -1.0, 0.0])
        want[run] = plain_losses(times)
        rows += [(run, i, x) for i, x in enumerate(times)] + [(run, 10_000, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {r["run_id"]: tuple(r)[1:] for r in ingest.loss_meter(spark.createDataFrame(rows, "run_id long, seq long, pub_s double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_live_clock_keeps_publish_spacing_over_a_jump(spark):
    rows = [("r", i, 100.0 + i + (0.4 if i == 2 else 0), 5.0 + i + (1000 if i >= 4 else 0)) for i in range(7)] + [("r", 9, 200.0, None)]
    got = {r["seq"]: (round(r["ts"], 6), r["jump"]) for r in sequence.live_clock(spark.createDataFrame(rows, "run_id string, seq long, recv_s double, pub_s double")).collect()}
    assert got == {**{i: (100.0 + i, i == 4) for i in range(7)}, 9: (200.0, False)}


def cdr(text):
    b = text.encode() + b"\0"
    return b"\0\1\0\0" + struct.pack("<I", len(b)) + b


def bag(path, texts, topic="/telemetry"):
    db = sqlite3.connect(path)
    db.execute("create table topics(id integer, name text, type text)")
    db.execute("create table messages(id integer, topic_id integer, timestamp integer, data blob)")
    db.executemany("insert into topics values(?,?,?)", [(1, topic, "std_msgs/msg/String"), (2, "/other", "x")])
    db.executemany("insert into messages values(?,?,?,?)", [(i + 1, 1, 10**18 + i * 10**7, cdr(t)) for i, t in enumerate(texts)] + [(99, 2, 5, b"1"), (100, 1, 6, b"\0\1")])
    db.commit()
    db.close()


def test_bags_csv_and_captures_give_the_same_samples(spark, tmp_path):
    texts = [json.dumps(payload(seq=i)) for i in range(3)]
    bag(str(tmp_path / "a.db3"), texts)
    raw = recordings.bag_payloads(spark, str(tmp_path / "a.db3"), "telemetry")
    assert [r["raw"] for r in raw.orderBy("seq").collect()] == texts
    streams = {r["topic"]: r["n"] for r in recordings.bag_streams(recordings.bag_messages(spark, str(tmp_path / "a.db3"))).collect()}
    assert streams == {"/telemetry": 4, "/other": 1}
    flat = lambda p: {(k if not isinstance(v, dict) else f"{k}.{n}"): x for k, v in p.items() for n, x in (v.items() if isinstance(v, dict) else [("", v)])}
    rows = [flat(payload(seq=i)) | {"timestamp": 10**18 + i} for i in range(3)]
    (tmp_path / "a.csv").write_text("\n".join([",".join(rows[0]), *[",".join(map(str, r.values())) for r in rows]]))
    csv = recordings.csv_payloads(spark, str(tmp_path / "a.csv"))
    assert [json.loads(r["raw"]) for r in csv.orderBy("seq").collect()] == [payload(seq=i) for i in range(3)]
    cols = [c for c in ingest.snapshots(raw).columns if c not in ("run_id", "seq", "ts")]
    body = lambda m: [[r["device_seq"], r["filtered_speed"], r["joulemeter"]["voltage"], r["gps"]["lon"]] for r in ingest.snapshots(m).orderBy("seq").collect()]
    assert body(raw) == body(csv) and "motor" in cols
    sinks.write_capture(raw.withColumn("recv_s", F.col("ts")), str(tmp_path / "c.live.tsv.gz"))
    back = recordings.live_capture(spark, str(tmp_path / "c.live.tsv.gz"))
    assert [r["raw"] for r in back.orderBy("seq").collect()] == texts
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in recordings.containers(spark, str(tmp_path / "a.*")).collect()}
    assert kinds == {"a.db3": "bag", "a.csv": "csv"}


def test_loose_csv_and_track_json(spark, tmp_path):
    (tmp_path / "l.csv").write_text("GPS Lat,gps_LON,Battery Voltage,Current\n1.5,2.5,48,\n,2,48,3\n")
    alias = {"lat": ["lat", "gpslat"], "lon": ["gpslon"], "voltage": ["batteryvoltage"], "current": ["current"]}
    got = [tuple(r)[1:] for r in recordings.loose_csv(spark, str(tmp_path / "l.csv"), alias).orderBy("seq").collect()]
    assert got == [(1.5, 2.5, None, None), (None, None, 48.0, 3.0)]
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"kind": "turn", "name": "Turn 1", "aliases": ["1"], "length_m": 3, "gate": [1, 2, 3, 4]}]}))
    assert recordings.track(spark, str(tmp_path / "t.json")).first()["gate_lon2"] == 4.0


def test_writers_replace_whole_runs_and_merge(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = lambda run, n, v: spark.createDataFrame([(run, i, v) for i in range(n)], "run_id string, seq long, v string")
    sinks.replace_runs(rows("a", 3, "x").unionByName(rows("b", 2, "x")), path)
    sinks.replace_runs(rows("a", 1, "y"), path)
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", "y"), ("b", "x"), ("b", "x")]
    ref = rows("a", 2, "z")
    assert sinks.seed(spark, str(tmp_path / "ref"), ref) and not sinks.seed(spark, str(tmp_path / "ref"), ref)
    with pytest.raises(ValueError):
        sinks.seed(spark, str(tmp_path / "ref"), rows("a", 1, "q"))


def test_tools(spark):
    segments = spark.createDataFrame([(0, "turn", "Turn 1", ["1"]), (1, "turn", "Turns 2-3", ["2", "3"]), (2, "straight", "Turn 3 to 4", ["3", "4"])], "ordinal int, kind string, name string, aliases array<string>")
    one = lambda text, kind: [r["ordinal"] for r in tools.resolve_segment(segments, text, kind).collect()]
    assert (one("TURN 1", "turn"), one("turn 3", "turn"), one("3-4", "straight"), one("9", "turn")) == ([0], [1], [2], [])
    inst = spark.createDataFrame([("r", 1, 10, 8.0, 6.0, None), ("r", 1, 20, 9.0, 9.5, 2.0), ("r", 1, 30, 9.0, 9.5, 1.0)], "run_id string, ordinal int, start_seq long, entry_speed double, exit_speed double, efficiency_mi_per_kwh double")
    assert tools.occurrence(inst, segments, "r", "turn 2", "turn", "first").first()["speed_delta"] == -2.0
    best = {r["start_seq"]: (r["is_fastest"], r["is_thriftiest"]) for r in tools.compare_instances(inst, "r", 1).collect()}
    assert best == {10: (False, False), 20: (True, True), 30: (False, False)}
    runs = spark.createDataFrame([("a", "upload", None, 10.0, "done", "East Lot", "x"), ("b", "live", "a", 11.0, "done", "East Lot", "x"), ("c", "live", None, 1.0, "recording", None, "x")], "run_id string, tier string, linked_run_id string, start_ts double, status string, location string, category string")
    assert [r["run_id"] for r in tools.list_runs(runs).collect()] == ["c", "a"]
    assert [r["run_id"] for r in tools.list_runs(runs, location="eastlot", include_live_twins=True).collect()] == ["b", "a"]
    assert [r["run_id"] for r in tools.list_runs(runs, until=5).collect()] == ["c"]


def test_guards_defaults():
    assert Guards() == Guards(5.0, 200.0, 40.0)
