"""Queries on `events` read as telemetry: a run is a user, seq is event_id, power follows `value`.

The table's steps are hours apart, so the guards are scaled (GUARDS); the operators' own
defaults are those of the car. Positions follow from event_id: a slow drift around one
place, the same arithmetic in Spark and in SQL.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.functions import geo, power
from voltlane.functions.scalar import epoch_s
from voltlane.operators import catalog, intervals, jsontree, library, metrics, sequence, tools, track
from voltlane.operators.metrics import Guards, by_run
from voltlane.registry import query, table

GUARDS = Guards(max_gap_s=86_400.0, max_jump_m=200.0, max_mps=40.0)
SESSION_GAP_S, MARGIN_S = 43_200.0, 7_200.0


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("run_id"), k.alias("seq"), epoch_s("ts").alias("t"), "event_type", "value", "props",
        F.when(k % 11 != 0, power.power_kw(F.col("value"), F.lit(48.0))).alias("p"),
        (42.0 + (k % 97) * 0.00001 + (k % 13) * 0.00002).alias("lat"), (-76.0 - (k % 89) * 0.00001).alias("lon"),
        F.lit(None).cast("double").alias("fix_t"),
    )


EV = """ev AS (SELECT user_id AS run_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type, value, props,
  CASE WHEN event_id % 11 <> 0 THEN greatest(0.0, value * 48.0 / 1000) END AS p,
  42.0 + (event_id % 97) * 0.00001::DOUBLE + (event_id % 13) * 0.00002::DOUBLE AS lat, -76.0 - (event_id % 89) * 0.00001::DOUBLE AS lon FROM events)"""
STEP = """pw AS (SELECT *, lag(t) OVER w AS t0, lag(p) OVER w AS p0 FROM ev WHERE p IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 st AS (SELECT *, CASE WHEN t - t0 > 0 AND t - t0 <= 86400 THEN (p0 + p) / 2 * (t - t0) / 3600 ELSE 0 END AS kwh FROM pw)"""
_A, _E2 = geo.WGS84_A, geo.WGS84_E2


def tangent_sql(a: str, b: str, c: str, d: str) -> str:
    ecef = lambda la, lo: [f"({_A} / sqrt(1 - {_E2} * pow(sin(radians({la})), 2)) * cos(radians({la})) * cos(radians({lo})))", f"({_A} / sqrt(1 - {_E2} * pow(sin(radians({la})), 2)) * cos(radians({la})) * sin(radians({lo})))", f"({_A} / sqrt(1 - {_E2} * pow(sin(radians({la})), 2)) * (1 - {_E2}) * sin(radians({la})))"]
    dx, dy, dz = (f"({q} - {p})" for p, q in zip(ecef(a, b), ecef(c, d), strict=True))
    east = f"(cos(radians({b})) * {dy} - sin(radians({b})) * {dx})"
    north = f"(cos(radians({a})) * {dz} - sin(radians({a})) * (cos(radians({b})) * {dx} + sin(radians({b})) * {dy}))"
    return f"sqrt(pow({east}, 2) + pow({north}, 2))"


FIX = f"""fx AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(t) OVER w AS ft0 FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 ds0 AS (SELECT * FROM fx WHERE lat0 IS NULL OR lat <> lat0 OR lon <> lon0),
 ds AS (SELECT run_id, seq, t, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS b, lag(t) OVER w AS t0 FROM ds0 WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 dd AS (SELECT *, {tangent_sql("a", "b", "lat", "lon")} AS d FROM ds),
 dm AS (SELECT *, CASE WHEN t - t0 <= 86400 AND d <= 200 AND (d <= 1 OR (t - t0 > 0 AND d / (t - t0) <= 40)) THEN d ELSE 0 END AS m FROM dd)"""

SUMMARY_SQL = f"""WITH {EV}, {STEP}, {FIX},
 en AS (SELECT run_id, CASE WHEN count(*) >= 2 THEN sum(kwh) * 1000 END AS wh FROM st GROUP BY 1),
 di AS (SELECT run_id, CASE WHEN count(*) >= 2 THEN sum(coalesce(m, 0)) END AS m FROM dm GROUP BY 1),
 sp AS (SELECT run_id, count(*) AS n_rows, CASE WHEN count(*) >= 2 THEN arg_max(t, seq) - arg_min(t, seq) END AS s FROM ev GROUP BY 1)
SELECT run_id, n_rows, round(wh, 3) AS energy_wh, round(m, 3) AS distance_m, round(s, 3) AS duration_s,
  round(CASE WHEN wh > 0 THEN (m / 1609.344) / (wh / 1000) END, 6) AS efficiency_mi_per_kwh, round(CASE WHEN s > 0 THEN m / s END, 6) AS avg_speed
FROM sp LEFT JOIN en USING (run_id) LEFT JOIN di USING (run_id)"""


@query(SUMMARY_SQL)
def run_summary(spark, sf_dir):
    s = metrics.run_summary(snapshots(spark, sf_dir), GUARDS)
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select("run_id", "n_rows", r("energy_wh", 3), r("distance_m", 3), r("duration_s", 3), r("efficiency_mi_per_kwh", 6), r("avg_speed", 6))


@query(f"WITH {EV}, {STEP} SELECT run_id, count(*) AS n_samples, count(*) FILTER (WHERE t - t0 > 86400) AS n_gaps, round(sum(kwh), 6) AS kwh FROM st GROUP BY 1")
def energy_gap_guard(spark, sf_dir):
    s = metrics.power_steps(snapshots(spark, sf_dir), GUARDS)
    gap = F.col("t") - F.col("t_before") > GUARDS.max_gap_s
    return s.groupBy("run_id").agg(F.count("*").alias("n_samples"), F.count_if(gap).alias("n_gaps"), F.round(F.sum("step_kwh"), 6).alias("kwh"))


@query(f"""WITH {EV}, {STEP}, b AS (SELECT run_id, min(t) + 0.25 * (max(t) - min(t)) AS lo, min(t) + 0.75 * (max(t) - min(t)) AS hi FROM ev GROUP BY 1),
 c AS (SELECT st.run_id, t, t0, p, p0, greatest(t0, lo) AS a, least(t, hi) AS z FROM st JOIN b USING (run_id)),
 k AS (SELECT run_id, CASE WHEN t - t0 > 0 AND t - t0 <= 86400 AND z > a THEN ((p0 + (p - p0) * (a - t0) / (t - t0)) + (p0 + (p - p0) * (z - t0) / (t - t0))) / 2 * (z - a) / 3600 ELSE 0 END AS kwh FROM c)
SELECT run_id, round(sum(kwh), 6) AS kwh FROM k GROUP BY 1""")
def energy_clipped_interval(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    span = F.max("t") - F.min("t")
    bounds = s.groupBy("run_id").agg((F.min("t") + 0.25 * span).alias("low"), (F.min("t") + 0.75 * span).alias("high"))
    steps = metrics.power_steps(s, GUARDS).join(bounds, "run_id")
    kwh = power.clipped_step_kwh(F.col("p_before"), F.col("p"), F.col("t_before"), F.col("t"), F.col("low"), F.col("high"), GUARDS.max_gap_s)
    return steps.groupBy("run_id").agg(F.round(F.sum(F.when(F.col("t_before").isNotNull(), kwh).otherwise(0.0)), 6).alias("kwh"))


@query(f"WITH {EV}, {STEP}, x AS (SELECT value * 48 / 1000 AS kw, (seq % 37) + 0.5 AS mps FROM ev) SELECT count(*) AS n, round(avg(mps * 2.23694 / kw), 6) AS mean_mi_per_kwh FROM x WHERE kw > 0")
def instant_efficiency(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    e = power.instant_efficiency(F.col("seq") % 37 + 0.5, power.power_kw(F.col("value"), F.lit(48.0)))
    return s.select(e.alias("e")).where("e is not null").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean_mi_per_kwh"))


@query(f"WITH {EV}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM ev) SELECT run_id, seq, event_type FROM l WHERE b IS NULL OR b <> event_type")
def consecutive_repeat_drop(spark, sf_dir):
    return sequence.drop_repeats(snapshots(spark, sf_dir), F.col("event_type")).select("run_id", "seq", "event_type")


@query(f"WITH {EV}, l AS (SELECT *, lag(seq % 5) OVER w AS ds, lag(event_type) OVER w AS b FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT run_id, count(*) AS conflicts FROM l WHERE ds = seq % 5 AND b <> event_type GROUP BY 1")
def seq_conflicts(spark, sf_dir):
    s, w = snapshots(spark, sf_dir), by_run()
    same = (F.lag(F.col("seq") % 5).over(w) == F.col("seq") % 5) & (F.lag("event_type").over(w) != F.col("event_type"))
    return s.withColumn("c", same).where("c").groupBy("run_id").agg(F.count("*").alias("conflicts"))


@query(f"WITH {EV}, {FIX} SELECT run_id, count(*) AS n_fixes, round(sum(coalesce(m, 0)), 3) AS distance_m FROM dm GROUP BY 1")
def distinct_fixes_path_distance(spark, sf_dir):
    d = metrics.distance_steps(snapshots(spark, sf_dir), GUARDS)
    return d.groupBy("run_id").agg(F.count("*").alias("n_fixes"), F.round(F.sum("step_m"), 3).alias("distance_m"))


def pairs(spark, sf_dir):
    w = by_run()
    s = snapshots(spark, sf_dir).select("run_id", "seq", "lat", "lon", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"))
    return s.where("lat0 is not null")


PAIRS = "pr AS (SELECT * FROM (SELECT run_id, seq, lat, lon, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY seq)) WHERE lat0 IS NOT NULL)"
HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2), 1.0)))"


@query(f"WITH {EV}, {PAIRS} SELECT run_id, seq, round({HAVERSINE}, 4) AS m FROM pr")
def haversine_pairs(spark, sf_dir):
    d = geo.haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return pairs(spark, sf_dir).select("run_id", "seq", F.round(d, 4).alias("m"))


@query(f"WITH {EV}, {PAIRS} SELECT run_id, seq, round({tangent_sql('lat0', 'lon0', 'lat', 'lon')}, 4) AS m FROM pr")
def tangent_pairs(spark, sf_dir):
    d = geo.tangent_distance_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return pairs(spark, sf_dir).select("run_id", "seq", F.round(d, 4).alias("m"))


def gates(spark):
    """Seventeen gates across the drift, one after another."""
    k = F.col("id")
    return spark.range(17).select(k.cast("int").alias("ordinal"), k.alias("segment_id"), F.when(k % 4 == 3, "straight").otherwise("turn").alias("kind"), F.concat(F.lit("Gate "), (k + 1).cast("string")).alias("name"), (42.0 + k * 0.00007 + 0.000003).alias("gate_lat1"), F.lit(-76.0009).alias("gate_lon1"), (42.0 + k * 0.00007 + 0.000004).alias("gate_lat2"), F.lit(-75.9999).alias("gate_lon2"))


GATES = "ga AS (SELECT k::INT AS ordinal, 42.0 + k * 0.00007::DOUBLE + 0.000003::DOUBLE AS g1, -76.0009::DOUBLE AS h1, 42.0 + k * 0.00007::DOUBLE + 0.000004::DOUBLE AS g2, -75.9999::DOUBLE AS h2 FROM range(17) r(k))"
_UP = geo.EARTH_RADIUS_M * 3.141592653589793 / 180


@query(f"""WITH {EV}, {PAIRS}, {GATES},
 v AS (SELECT ordinal, (lon - lon0) * cos(radians(g1)) * {_UP} AS wx, (lat - lat0) * {_UP} AS wy, (h2 - h1) * cos(radians(g1)) * {_UP} AS gx, (g2 - g1) * {_UP} AS gy,
   (h1 - lon0) * cos(radians(g1)) * {_UP} AS ox, (g1 - lat0) * {_UP} AS oy FROM pr, ga),
 c AS (SELECT ordinal, wx * gy - wy * gx AS cr, ox, oy, gx, gy, wx, wy FROM v),
 f AS (SELECT ordinal, (ox * gy - oy * gx) / cr AS f, (ox * wy - oy * wx) / cr AS u FROM c WHERE abs(cr) >= 1e-9)
SELECT ordinal, count(*) AS n, round(sum(f), 4) AS sum_f FROM f WHERE f BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY 1""")
def gate_crossings(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumnsRenamed({"lat0": "p_lat", "lon0": "p_lon"})
    return track.gate_crossings(p, gates(spark)).groupBy("ordinal").agg(F.count("*").alias("n"), F.round(F.sum("f"), 4).alias("sum_f"))


LINE = (42.0004, -76.0004, 30.0)
INSIDE = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(42.0004 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(42.0004)) * pow(sin(radians(-76.0004 - lon) / 2), 2), 1.0))) <= 30.0"
LAPS = f"""li AS (SELECT run_id, seq, t, {INSIDE} AS ins FROM ev),
 le AS (SELECT *, lag(ins) OVER w AS b, row_number() OVER w AS rn FROM li WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 lc AS (SELECT run_id, row_number() OVER w AS lap_number, seq AS start_seq, lead(seq) OVER w AS end_seq, t AS start_ts, lead(t) OVER w AS end_ts FROM le WHERE rn = 1 OR (ins AND NOT b) WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 lp AS (SELECT * FROM lc WHERE end_seq IS NOT NULL)"""


def laps(spark, sf_dir):
    return track.lap_edges(snapshots(spark, sf_dir), *LINE)


@query(f"WITH {EV}, {LAPS} SELECT run_id, lap_number, start_seq, end_seq, round(start_ts, 3) AS start_ts, round(end_ts, 3) AS end_ts FROM lp")
def laps_edges(spark, sf_dir):
    return laps(spark, sf_dir).select("run_id", "lap_number", "start_seq", "end_seq", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"))


@query(f"""WITH {EV}, {STEP}, {FIX}, {LAPS},
 pp AS (SELECT *, lag(seq) OVER (PARTITION BY run_id ORDER BY seq) AS q FROM st),
 en AS (SELECT l.run_id, lap_number, count(*) AS n, sum(CASE WHEN q >= start_seq THEN kwh ELSE 0 END) * 1000 AS wh FROM lp l JOIN pp ON l.run_id = pp.run_id AND seq BETWEEN start_seq AND end_seq GROUP BY 1, 2),
 du AS (SELECT l.run_id, lap_number, count(*) AS n, arg_max(t, seq) - arg_min(t, seq) AS s FROM lp l JOIN ev ON l.run_id = ev.run_id AND seq BETWEEN start_seq AND end_seq GROUP BY 1, 2)
SELECT l.run_id, l.lap_number, round(CASE WHEN en.n >= 2 THEN wh END, 3) AS energy_wh, round(CASE WHEN du.n >= 2 THEN s END, 3) AS duration_s
FROM lp l LEFT JOIN en USING (run_id, lap_number) LEFT JOIN du USING (run_id, lap_number)""")
def lap_metrics(spark, sf_dir):
    m = metrics.range_metrics(snapshots(spark, sf_dir), laps(spark, sf_dir).select("run_id", "lap_number", "start_seq", "end_seq"), GUARDS)
    return m.select("run_id", "lap_number", F.round("energy_wh", 3).alias("energy_wh"), F.round("duration_s", 3).alias("duration_s"))


@query(f"""WITH {EV}, {LAPS} SELECT l.run_id, l.lap_number, count(e.seq) AS turn_count FROM lp l LEFT JOIN ev e ON e.run_id = l.run_id AND e.event_type = 'click' AND e.seq > l.start_seq AND e.seq <= l.end_seq GROUP BY 1, 2""")
def turn_count(spark, sf_dir):
    turns = snapshots(spark, sf_dir).where("event_type = 'click'").select("run_id", F.col("seq").alias("start_seq"))
    keyed = laps(spark, sf_dir).select("run_id", "lap_number", "start_seq", "end_seq")
    return track.lap_metrics(snapshots(spark, sf_dir), keyed, turns, GUARDS).select("run_id", "lap_number", "turn_count")


@query()
def laps_glitch_guard(spark, sf_dir):
    """Laps by the guarded state machine (needs all rows before; SQL cannot express it)."""
    return track.lap_intervals(snapshots(spark, sf_dir), *LINE, max_mps=0.002)


def drive(spark, sf_dir):
    """Events as drives past the gates: each run's k-th row is its k-th second, 5.6 m further north than the
    one before, and after 25 rows back at the start, which is a dropout."""
    k = F.row_number().over(by_run()).cast("long")
    s = snapshots(spark, sf_dir).select("run_id", "event_type", "value", "p", k.alias("k"))
    return s.select("run_id", F.col("k").alias("seq"), F.col("k").cast("double").alias("t"), F.col("k").cast("double").alias("fix_t"), "p", (42.0 + (F.col("k") % 25) * 0.00005).alias("lat"), F.lit(-76.0004).alias("lon"))


DRIVE = f"""dr AS (SELECT run_id, k AS seq, k::DOUBLE AS t, p, 42.0 + (k % 25) * 0.00005::DOUBLE AS lat, -76.0004::DOUBLE AS lon FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS k FROM ev)),
 dp AS (SELECT run_id, seq, t, lat, lon, lag(t) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM dr WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 dc AS (SELECT *, {tangent_sql("lat0", "lon0", "lat", "lon")} AS d FROM dp WHERE t0 IS NOT NULL),
 dv AS (SELECT run_id, seq, t, t0, d, ordinal, (lon - lon0) * cos(radians(g1)) * {_UP} AS wx, (lat - lat0) * {_UP} AS wy, (h2 - h1) * cos(radians(g1)) * {_UP} AS gx, (g2 - g1) * {_UP} AS gy, (h1 - lon0) * cos(radians(g1)) * {_UP} AS ox, (g1 - lat0) * {_UP} AS oy FROM dc, ga WHERE d <= 120),
 df AS (SELECT *, (ox * gy - oy * gx) / (wx * gy - wy * gx) AS f, (ox * wy - oy * wx) / (wx * gy - wy * gx) AS u FROM dv WHERE abs(wx * gy - wy * gx) >= 1e-9),
 cr AS (SELECT run_id, seq // 25 AS sweep, ordinal, seq, t0 + f * (t - t0) AS ct, f, d FROM df WHERE f BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
 sg AS (SELECT * FROM (SELECT run_id, ordinal, seq AS enter_seq, ct AS enter_t, f AS enter_f, d AS enter_d, lead(seq) OVER w AS exit_seq, lead(ct) OVER w AS exit_t, lead(f) OVER w AS exit_f, lead(d) OVER w AS exit_d, lead(ordinal) OVER w AS nxt FROM cr WINDOW w AS (PARTITION BY run_id, sweep ORDER BY seq, f)) WHERE nxt = ordinal + 1),
 st AS (SELECT run_id, seq, t, p, lag(seq) OVER w AS q_seq, lag(t) OVER w AS q_t, lag(p) OVER w AS q_p FROM dr WHERE p IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 pt AS (SELECT s.run_id, s.ordinal, s.enter_seq, s.exit_seq, q_seq >= enter_seq - 1 AS counts, t - q_t AS dt, q_t, t, q_p, p, greatest(q_t, enter_t) AS a, least(t, exit_t) AS z FROM sg s JOIN st ON st.run_id = s.run_id AND st.seq BETWEEN s.enter_seq - 1 AND s.exit_seq),
 en AS (SELECT run_id, ordinal, enter_seq, exit_seq, CASE WHEN count(*) >= 2 THEN 1000 * sum(CASE WHEN counts AND dt > 0 AND dt <= 86400 AND z > a THEN ((q_p + (p - q_p) * (a - q_t) / dt) + (q_p + (p - q_p) * (z - q_t) / dt)) / 2 * (z - a) / 3600 ELSE 0 END) END AS wh FROM pt GROUP BY ALL),
 mi AS (SELECT s.run_id, s.ordinal, s.enter_seq, s.exit_seq, sum(dc.d) AS m FROM sg s JOIN dc ON dc.run_id = s.run_id AND dc.seq > s.enter_seq AND dc.seq < s.exit_seq GROUP BY ALL)"""


@query(f"""WITH {EV}, {GATES}, {DRIVE}
SELECT s.run_id, s.ordinal, s.enter_seq AS start_seq, s.exit_seq AS end_seq, round(enter_t, 4) AS enter_t, round(exit_t - enter_t, 4) AS duration_s, round(en.wh, 6) AS energy_wh, round((1 - enter_f) * enter_d + coalesce(mi.m, 0) + exit_f * exit_d, 3) AS distance_m
FROM sg s LEFT JOIN en USING (run_id, ordinal, enter_seq, exit_seq) LEFT JOIN mi USING (run_id, ordinal, enter_seq, exit_seq)""")
def segments_state_machine(spark, sf_dir):
    """Finished segments between successive gates, by the state machine, with their totals."""
    s, g = drive(spark, sf_dir), gates(spark)
    m = track.segment_metrics(s, track.segment_instances(s, g), g, GUARDS)
    r = lambda c, n: F.round(c, n).alias(c)
    return m.select("run_id", "ordinal", "start_seq", "end_seq", r("enter_t", 4), r("duration_s", 4), r("energy_wh", 6), r("distance_m", 3))


SESSIONS = "ss AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, t - lag(t) OVER (PARTITION BY run_id ORDER BY seq) AS g FROM ev))"


@query(f"WITH {EV}, {SESSIONS} SELECT run_id, session::BIGINT AS session, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, round(max(t) - min(t), 3) AS duration_s FROM ss GROUP BY 1, 2")
def gap_sessions(spark, sf_dir):
    s = sequence.gap_sessions(snapshots(spark, sf_dir), SESSION_GAP_S)
    return s.groupBy("run_id", "session").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.round(F.max("t") - F.min("t"), 3).alias("duration_s"))


@query(f"WITH {EV}, {SESSIONS} SELECT run_id, count(*) AS n, round(min(t), 3) AS start_s, round(max(t) + 43200, 3) AS end_s FROM ss GROUP BY run_id, session")
def session_window(spark, sf_dir):
    """The same sessions by Spark's own session window (a silence of exactly the gap also ends one there)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"))
    s = e.groupBy("run_id", F.session_window("at", f"{int(SESSION_GAP_S)} seconds").alias("w")).agg(F.count("*").alias("n"))
    seconds = lambda c: epoch_s(F.col(c).cast("timestamp_ntz"))
    return s.select("run_id", "n", F.round(seconds("w.start"), 3).alias("start_s"), F.round(seconds("w.end"), 3).alias("end_s"))


@query(f"WITH {EV}, n AS (SELECT run_id, max(t) AS n FROM ev GROUP BY 1) SELECT run_id, max(seq) FILTER (WHERE t <= n - 7200) AS until_seq, max(seq) AS last_seq FROM ev JOIN n USING (run_id) GROUP BY 1")
def lookback_margin(spark, sf_dir):
    return sequence.lookback_bound(snapshots(spark, sf_dir), MARGIN_S)


@query(f"WITH {EV}, {LAPS} SELECT e.run_id, e.seq, l.lap_number, round(e.t - min(e.t) OVER (PARTITION BY e.run_id), 3) AS run_t FROM ev e LEFT JOIN lp l ON e.run_id = l.run_id AND e.seq >= l.start_seq AND e.seq < l.end_seq")
def samples_view_lap(spark, sf_dir):
    s = snapshots(spark, sf_dir).withColumn("run_t", F.round(F.col("t") - F.min("t").over(Window.partitionBy("run_id")), 3))
    return intervals.interval_of(s, laps(spark, sf_dir), "lap_number").select("run_id", "seq", "lap_number", "run_t")


SEGS = "sg AS (SELECT run_id, 'turn ' || (k % 3 + 1)::VARCHAR AS segment, seq AS start_seq, nxt AS end_seq FROM (SELECT *, lead(seq) OVER w AS nxt, row_number() OVER w AS k FROM ev WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY run_id ORDER BY seq)) WHERE nxt IS NOT NULL AND k % 3 <> 0)"


@query(f"WITH {EV}, {SEGS} SELECT e.run_id, e.seq, s.segment FROM ev e LEFT JOIN sg s ON e.run_id = s.run_id AND e.seq >= s.start_seq AND e.seq < s.end_seq")
def samples_view_segment(spark, sf_dir):
    s, w = snapshots(spark, sf_dir), by_run()
    cuts = s.where("event_type = 'purchase'").withColumns({"end_seq": F.lead("seq").over(w), "k": F.row_number().over(w)}).where("end_seq is not null and k % 3 <> 0")
    segs = cuts.select("run_id", F.concat(F.lit("turn "), (F.col("k") % 3 + 1).cast("string")).alias("segment"), F.col("seq").alias("start_seq"), "end_seq")
    return intervals.interval_of(s, segs, "segment").select("run_id", "seq", "segment")


@query(f"WITH {EV}, v AS (SELECT run_id, seq, CASE WHEN seq % 7 < 3 THEN value END AS v FROM ev) SELECT run_id, seq, round(last_value(v IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS v_last FROM v")
def last_known_value(spark, sf_dir):
    s = snapshots(spark, sf_dir).select("run_id", "seq", F.when(F.col("seq") % 7 < 3, F.col("value")).alias("v"))
    return sequence.last_known(s, ["v"]).select("run_id", "seq", F.round("v_last", 4).alias("v_last"))


@query(f"WITH {EV}, v AS (SELECT *, CASE WHEN seq % 7 < 3 THEN value END AS v FROM ev) SELECT run_id, max(seq) AS seq, arg_max(event_type, seq) AS event_type, round(arg_max(v, seq) FILTER (WHERE v IS NOT NULL), 4) AS v FROM v GROUP BY 1")
def latest_sample(spark, sf_dir):
    s = snapshots(spark, sf_dir).select("run_id", "seq", "event_type", F.when(F.col("seq") % 7 < 3, F.col("value")).alias("v"))
    return sequence.latest_sample(s, ["v"]).select("run_id", "seq", "event_type", F.round("v", 4).alias("v"))


@query(f"""WITH {EV}, w AS (SELECT *, max(t) OVER (PARTITION BY run_id) AS e FROM ev), n AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS c FROM w WHERE t >= e - 1000000)
SELECT run_id, seq FROM n WHERE c <= 20 OR i = c - 1 OR i IN (SELECT unnest([k * c // 20 FOR k IN range(19)]))""")
def live_window_downsample(spark, sf_dir):
    return sequence.live_window(snapshots(spark, sf_dir), 1_000_000, 20, most_seconds=1_000_000).select("run_id", "seq")


CLOCK = "ck AS (SELECT run_id, seq, t AS recv, CASE WHEN seq % 17 <> 0 THEN t + (seq % 5) * 0.25 + (CASE WHEN seq % 1000 > 500 THEN 3600 ELSE 0 END) END AS pub FROM ev)"


def clock_rows(spark, sf_dir):
    k = F.col("seq")
    pub = F.when(k % 17 != 0, F.col("t") + (k % 5) * 0.25 + F.when(k % 1000 > 500, 3600).otherwise(0))
    return snapshots(spark, sf_dir).select("run_id", "seq", F.col("t").alias("recv_s"), pub.alias("pub_s"))


@query(f"""WITH {EV}, {CLOCK}, l AS (SELECT *, pub - lag(pub) OVER w AS dp, recv - lag(recv) OVER w AS dr FROM ck WHERE pub IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 s AS (SELECT run_id, seq, sum(CASE WHEN dp IS NULL THEN recv WHEN abs(dp - dr) > 30 THEN greatest(dr, 0) ELSE dp END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ts, coalesce(abs(dp - dr) > 30, false) AS jump FROM l)
SELECT run_id, seq, round(ts, 3) AS ts, jump FROM s UNION ALL SELECT run_id, seq, round(recv, 3), false FROM ck WHERE pub IS NULL""")
def live_clock(spark, sf_dir):
    return sequence.live_clock(clock_rows(spark, sf_dir)).select("run_id", "seq", F.round("ts", 3).alias("ts"), "jump")


@query(f"""WITH {EV}, {CLOCK}, g AS (SELECT run_id, pub - lag(pub) OVER (PARTITION BY run_id ORDER BY seq) AS g FROM ck WHERE pub IS NOT NULL)
SELECT run_id, count(*) FILTER (WHERE g < 0) AS backwards, count(*) FILTER (WHERE g > 50000) AS outages, round(sum(CASE WHEN g > 50000 THEN g ELSE 0 END), 3) AS outage_s,
 count(*) FILTER (WHERE g <= 50000 AND g >= 12500) AS holes, sum(CASE WHEN g <= 50000 AND g >= 12500 THEN greatest(1, round_even(g / 5000, 0)::BIGINT - 1) ELSE 0 END)::BIGINT AS missing, round(greatest(max(g), 0), 3) AS max_gap_s
FROM g WHERE g IS NOT NULL GROUP BY 1""")
def loss_gaps(spark, sf_dir):
    g = sequence.loss_gaps(clock_rows(spark, sf_dir), 5000.0, outage_s=50_000.0)
    return g.select("run_id", "backwards", "outages", F.round("outage_s", 3).alias("outage_s"), "holes", "missing", F.round("max_gap_s", 3).alias("max_gap_s"))


@query(f"WITH {EV}, r AS (SELECT *, lag(seq % 100) OVER w AS s0, lag(t - (seq % 3) * 100000) OVER w AS d0 FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT run_id, seq FROM r WHERE seq % 100 < s0 AND d0 - (t - (seq % 3) * 100000) > 1")
def reboot_detection(spark, sf_dir):
    k = F.col("seq")
    s = snapshots(spark, sf_dir).select("run_id", "seq", (k % 100).alias("device_seq"), (F.col("t") - (k % 3) * 100000).alias("device_t"))
    return sequence.reboots(s).where("reboot").select("run_id", "seq")


@query(f"""WITH {EV}, g AS (SELECT run_id, seq AS around, t - 50000 AS target FROM ev WHERE event_type = 'purchase'),
 e AS (SELECT g.run_id, g.around, max(x.seq) AS early FROM g JOIN ev x ON x.run_id = g.run_id AND x.seq <= g.around AND x.seq > g.around - 3000 AND x.t < g.target GROUP BY 1, 2)
SELECT g.run_id, g.around AS around_seq, min(x.seq) AS found_seq FROM g LEFT JOIN e USING (run_id, around) JOIN ev x ON x.run_id = g.run_id AND x.seq <= g.around AND x.seq > g.around - 3000 AND (e.early IS NULL OR x.seq > e.early) GROUP BY 1, 2""")
def forward_as_of(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    targets = s.where("event_type = 'purchase'").select("run_id", F.col("seq").alias("target_id"), (F.col("t") - 50_000).alias("target_t"), F.col("seq").alias("around_seq"))
    return sequence.first_at_or_after(s, targets).select("run_id", "around_seq", "found_seq")


@query(f"""WITH {EV}, {LAPS}, s AS ({SUMMARY_SQL.replace("WITH " + EV + ",", "WITH")}), l AS (SELECT run_id, count(*) AS n FROM lp GROUP BY 1), a AS (SELECT run_id, min(t) AS s, max(t) AS e FROM ev GROUP BY 1)
SELECT run_id, round(a.s, 3) AS start_s, round(a.e - a.s, 3) AS span_s, coalesce(l.n, 0) AS lap_count, s.energy_wh, s.distance_m, row_number() OVER (ORDER BY coalesce(a.s, 0) DESC, run_id) AS place FROM a LEFT JOIN l USING (run_id) LEFT JOIN s USING (run_id)""")
def list_runs(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    spans = s.groupBy("run_id").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    counts = laps(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("lap_count"))
    out = spans.join(counts, "run_id", "left").join(run_summary(spark, sf_dir).select("run_id", "energy_wh", "distance_m"), "run_id", "left")
    # a listing's place needs one order over all runs: one row per run, never per snapshot
    place = F.row_number().over(Window.orderBy(F.coalesce("s", F.lit(0.0)).desc(), "run_id")).cast("long")
    return out.select("run_id", F.round("s", 3).alias("start_s"), F.round(F.col("e") - F.col("s"), 3).alias("span_s"), F.coalesce("lap_count", F.lit(0).cast("long")).alias("lap_count"), "energy_wh", "distance_m", place.alias("place"))


@query(f"""WITH {EV}, {LAPS}, d AS (SELECT run_id, lap_number, end_ts - start_ts AS s, end_seq - start_seq AS n FROM lp)
SELECT a.run_id, a.lap_number AS lap_a, b.lap_number AS lap_b, round(a.s, 3) AS duration_a, round(b.s, 3) AS duration_b, round(b.s - a.s, 3) AS duration_delta, b.n - a.n AS rows_delta FROM d a JOIN d b ON a.run_id = b.run_id AND b.lap_number = a.lap_number + 1""")
def compare_laps(spark, sf_dir):
    d = laps(spark, sf_dir).select("run_id", "lap_number", (F.col("end_ts") - F.col("start_ts")).alias("s"), (F.col("end_seq") - F.col("start_seq")).alias("n"))
    a, b = (d.select("run_id", F.col("lap_number").alias(f"lap_{x}"), F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = a.join(b.withColumn("lap_a", F.col("lap_b") - 1), ["run_id", "lap_a"])
    return both.select("run_id", "lap_a", "lap_b", F.round("s_a", 3).alias("duration_a"), F.round("s_b", 3).alias("duration_b"), F.round(F.col("s_b") - F.col("s_a"), 3).alias("duration_delta"), (F.col("n_b") - F.col("n_a")).alias("rows_delta"))


@query(f"""WITH {EV} SELECT run_id, event_type, max(seq) AS latest_seq, min(seq) AS first_seq, arg_max(seq, {{'v': value, 's': -seq}}) AS best_seq FROM ev GROUP BY 1, 2""")
def latest_occurrence(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    return s.groupBy("run_id", "event_type").agg(F.max("seq").alias("latest_seq"), F.min("seq").alias("first_seq"), F.max_by("seq", F.struct("value", -F.col("seq"))).alias("best_seq"))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, event_type ORDER BY seq DESC) AS k FROM ev), c AS (SELECT * FROM r WHERE k <= 10)
SELECT run_id, event_type, count(*) AS n, arg_max(seq, {{'v': value, 's': -seq}}) AS fastest_seq, arg_min(seq, {{'v': value, 's': seq}}) AS thriftiest_seq FROM c GROUP BY 1, 2""")
def compare_instances(spark, sf_dir):
    w = Window.partitionBy("run_id", "event_type").orderBy(F.desc("seq"))
    c = snapshots(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 10")
    return c.groupBy("run_id", "event_type").agg(F.count("*").alias("n"), F.max_by("seq", F.struct("value", -F.col("seq"))).alias("fastest_seq"), F.min_by("seq", F.struct("value", F.col("seq"))).alias("thriftiest_seq"))


@query(f"WITH {EV}, c AS (SELECT run_id, seq, CASE WHEN seq % 3 <> 0 THEN event_type END AS v FROM ev) SELECT run_id, arg_min(v, seq) FILTER (WHERE v IS NOT NULL) AS first_known FROM c GROUP BY 1")
def first_nonnull_lookup(spark, sf_dir):
    v = F.when(F.col("seq") % 3 != 0, F.col("event_type"))
    return snapshots(spark, sf_dir).groupBy("run_id").agg(F.min_by(v, F.when(v.isNotNull(), F.col("seq"))).alias("first_known"))


@query(f"WITH {EV}, e AS (SELECT *, lag(value > 250) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM ev) SELECT run_id, count(*) AS presses FROM e WHERE value > 250 AND NOT b GROUP BY 1")
def rising_edges(spark, sf_dir):
    on = F.col("value") > 250
    return snapshots(spark, sf_dir).withColumn("b", F.lag(on).over(by_run())).where(on & ~F.col("b")).groupBy("run_id").agg(F.count("*").alias("presses"))


@query(f"""WITH {EV}, pl AS (SELECT n_nationkey::BIGINT AS place_id, 42.0 + (n_nationkey % 5) * 0.00025::DOUBLE AS a, -76.0 - (n_nationkey // 5) * 0.0002::DOUBLE AS b, 8.0 + n_nationkey AS r FROM nation),
 d AS (SELECT e.seq, pl.place_id, r, {HAVERSINE.replace("lat0", "e.lat").replace("lon0", "e.lon").replace("radians(lat -", "radians(pl.a -").replace("radians(lat)", "radians(pl.a)").replace("radians(lon -", "radians(pl.b -")} AS m FROM ev e, pl),
 b AS (SELECT seq, arg_min(place_id, {{'m': m, 'p': place_id}}) AS place_id, min(m) AS m FROM d WHERE m <= r GROUP BY 1)
SELECT e.seq AS point_id, b.place_id, round(b.m, 3) AS distance_m FROM ev e LEFT JOIN b USING (seq)""")
def nearest_in_radius(spark, sf_dir):
    k = F.col("n_nationkey")
    places = table(spark, sf_dir, "nation").select(k.cast("long").alias("place_id"), (42.0 + (k % 5) * 0.00025).alias("p_lat"), (-76.0 - F.floor(k / 5) * 0.0002).alias("p_lon"), (8.0 + k).alias("radius_m"))
    points = snapshots(spark, sf_dir).select(F.col("seq").alias("point_id"), "lat", "lon")
    return intervals.nearest_within(points, places).select("point_id", "place_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"WITH {EV} SELECT run_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, count(*) AS fixes FROM ev WHERE seq % 5 <> 0 GROUP BY 1")
def gps_box(spark, sf_dir):
    """The box of each run's fixes; every fifth row has none."""
    none = F.col("seq") % 5 == 0
    s = snapshots(spark, sf_dir)
    zero = F.when(F.col("seq") % 2 == 0, 0.0)
    s = s.withColumns({"lat": F.when(none, zero).otherwise(F.col("lat")), "lon": F.when(none, zero).otherwise(F.col("lon"))})
    return catalog.gps_box(s).select("run_id", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")], "fixes")


@query(f"WITH {EV}, m AS (SELECT run_id, floor(t / 86400) AS slot, max(t) AS mark, count(*) AS n FROM ev GROUP BY 1, 2), l AS (SELECT *, mark - lag(mark) OVER (PARTITION BY run_id ORDER BY slot) AS since FROM m) SELECT run_id, round(mark, 3) AS mark, CASE WHEN since >= 86400 THEN round(n / since, 9) END AS per_s FROM l")
def message_rate(spark, sf_dir):
    """Messages a second, from day to day."""
    return library.message_rate(snapshots(spark, sf_dir), "t", 86_400.0).select("run_id", F.round("at", 3).alias("mark"), F.round("per_s", 9).alias("per_s"))


@query(f"""WITH {EV}, m AS (SELECT run_id, seq, t, CASE WHEN seq % 40 < 10 THEN seq // 40 END AS bag_id, seq % 17 AS dseq, t - CASE WHEN seq % 5 = 0 THEN 1e6 ELSE 0 END AS dt, CASE WHEN seq % 3 <> 0 THEN event_type END AS schema FROM ev),
 b AS (SELECT *, row_number() OVER w = 1 AS first, bag_id IS DISTINCT FROM lag(bag_id) OVER w AS bag, coalesce(bag_id IS NULL AND t - lag(t) OVER w > 43200, false) AS gap, coalesce(dseq < lag(dseq) OVER w AND lag(dt) OVER w - dt > 1, false) AS reboot,
  coalesce(schema <> last_value(schema IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS other FROM m WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 c AS (SELECT *, CASE WHEN first THEN NULL WHEN bag THEN 'bag' WHEN gap THEN 'gap' WHEN reboot THEN 'reboot' WHEN other THEN 'schema' END AS cause FROM b),
 n AS (SELECT *, count(CASE WHEN first OR cause IS NOT NULL THEN 1 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM c),
 s AS (SELECT run_id, session, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, arg_min(cause, seq) FILTER (WHERE cause IS NOT NULL) AS cause FROM n GROUP BY 1, 2)
SELECT run_id, session, first_seq, last_seq, n, coalesce(lead(cause) OVER (PARTITION BY run_id ORDER BY session), 'open') AS end_reason FROM s""")
def sessions_by_cause(spark, sf_dir):
    """Sessions of every stream with the reason that ended each; bags, counters and schemas follow from event_id and event_type."""
    s = snapshots(spark, sf_dir)
    k = F.col("seq")
    rows = s.select("run_id", "seq", "t", F.when(k % 40 < 10, F.expr("seq div 40")).alias("bag_id"), (k % 17).alias("device_seq"), (F.col("t") - F.when(k % 5 == 0, 1e6).otherwise(0.0)).alias("device_t"), F.when(k % 3 != 0, F.col("event_type")).alias("schema"))
    return sequence.sessions(rows, gap_s=SESSION_GAP_S)


@query(f"""WITH {EV}, rec AS (SELECT run_id * 100000 + floor(t / 86400)::BIGINT % 100000 AS recording_id, CASE WHEN run_id % 3 <> 0 THEN run_id * 100000 + floor(t / 86400)::BIGINT % 100000 END AS run_id, min(t) AS recorded_start, max(t) AS recorded_end FROM ev GROUP BY run_id, floor(t / 86400)::BIGINT),
 f AS (SELECT run_id * 100000 + floor(t / 86400)::BIGINT % 100000 AS recording_id, seq AS rel_path FROM ev),
 a AS (SELECT recording_id AS ask_id, run_id, CASE WHEN recording_id % 40 = 0 THEN recorded_start + 600 END AS start_ts, CASE WHEN recording_id % 40 = 0 THEN recorded_end + 7200 END AS end_ts FROM rec WHERE recording_id % 20 = 0),
 w AS (SELECT a.ask_id, a.run_id, coalesce(a.start_ts, o.recorded_start) AS lo, coalesce(a.end_ts, o.recorded_end) AS hi FROM a LEFT JOIN rec o ON o.run_id = a.run_id),
 hit AS (SELECT DISTINCT ask_id, recording_id FROM w JOIN rec ON (lo <= hi AND recorded_start <= hi AND recorded_end >= lo) OR rec.run_id = w.run_id)
SELECT ask_id, recording_id, rel_path FROM hit JOIN f USING (recording_id)""")
def files_of_moments(spark, sf_dir):
    """Files that cover a run or a stretch of it, for every recording whose id is divisible by 20, against all recordings (one for each run and day)."""
    s = snapshots(spark, sf_dir)
    day = F.floor(F.col("t") / 86_400).cast("long")
    number = F.col("run_id") * 100_000 + day % 100_000
    rec = s.groupBy("run_id", day.alias("day")).agg(F.min("t").alias("recorded_start"), F.max("t").alias("recorded_end")).withColumn("recording_id", F.col("run_id") * 100_000 + F.col("day") % 100_000)
    rec = rec.select("recording_id", F.when(F.col("run_id") % 3 != 0, F.col("recording_id")).alias("run_id"), "recorded_start", "recorded_end")
    # read four times: kept, else each time deals all events by run and day
    rec = rec.persist(StorageLevel.MEMORY_AND_DISK)
    part = F.col("recording_id") % 40 == 0
    asks = rec.where("recording_id % 20 = 0").select(F.col("recording_id").alias("ask_id"), "run_id", F.when(part, F.col("recorded_start") + 600).alias("start_ts"), F.when(part, F.col("recorded_end") + 7200).alias("end_ts"))
    return catalog.find_files(asks, rec, s.select(number.alias("recording_id"), F.col("seq").alias("rel_path"))).select("ask_id", "recording_id", "rel_path")


@query(f"""WITH {EV}, {LAPS}, d AS (SELECT run_id, lap_number, end_ts - start_ts AS duration_s, end_seq - start_seq AS turn_count FROM lp)
SELECT a.run_id, round(a.duration_s, 3) AS duration_a, round(b.duration_s, 3) AS duration_b, round(b.duration_s - a.duration_s, 3) AS duration_delta, a.turn_count AS rows_a, b.turn_count AS rows_b FROM d a JOIN d b ON a.run_id = b.run_id AND a.lap_number = 1 AND b.lap_number = 2""")
def compare_first_laps(spark, sf_dir):
    """The first two laps of every run side by side."""
    d = laps(spark, sf_dir).withColumns({"duration_s": F.lit(None).cast("double"), "turn_count": F.col("end_seq") - F.col("start_seq")})
    both = tools.compare_laps(d, None, 1, 2, ("duration_s",))
    return both.select("run_id", F.round("duration_s_a", 3).alias("duration_a"), F.round("duration_s_b", 3).alias("duration_b"), F.round("duration_s_delta", 3).alias("duration_delta"), F.col("turn_count_a").alias("rows_a"), F.col("turn_count_b").alias("rows_b"))


TIERS = """r AS (SELECT run_id, min(t) AS start_ts, 'p' || (run_id % 4) AS location, CASE WHEN run_id % 2 = 0 THEN 'testing' ELSE 'competition' END AS category, CASE WHEN run_id % 11 = 0 THEN 'recording' ELSE 'done' END AS status, CASE WHEN run_id % 6 = 0 THEN run_id + 1 END AS linked_run_id FROM ev GROUP BY 1),
 u AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN 'live' ELSE 'upload' END AS tier FROM r)"""


@query(f"""WITH {EV}, {TIERS} SELECT run_id, tier, status, round(start_ts, 3) AS start_ts FROM u
WHERE (tier <> 'live' OR linked_run_id IS NULL) AND category = 'testing' AND location = 'p2' ORDER BY status <> 'recording', start_ts DESC, run_id LIMIT 100""")
def list_runs_of_both_tiers(spark, sf_dir):
    """The newest hundred test runs of one place, of the live and the main store as one, without live twins of uploads."""
    k = F.col("run_id")
    r = snapshots(spark, sf_dir).groupBy("run_id").agg(F.min("t").alias("start_ts")).withColumns({
        "location": F.concat(F.lit("P "), (k % 4).cast("string")), "category": F.when(k % 2 == 0, "testing").otherwise("competition"),
        "status": F.when(k % 11 == 0, "recording").otherwise("done"), "linked_run_id": F.when(k % 6 == 0, k + 1),
    })
    # the main store has all runs, the live store every third again
    runs = tools.one_view(r, r.where(k % 3 == 0))
    return tools.list_runs(runs, location="p2", category="testing", limit=100).select("run_id", "tier", "status", F.round("start_ts", 3).alias("start_ts"))


DOC = """d AS (SELECT event_id, user_id, '{"type": "' || event_type || '", "p": ' || props || ', "list": [' || (event_id % 3) || ', null, {"deep": [true, "a b", ' || (event_id % 7) || '.5]}], "odd key": {}}' AS doc FROM events)"""


def nested_events(spark, sf_dir):
    """event_id, user_id and a nested JSON text of each event."""
    k = F.col("event_id")
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "p": '), "props", F.lit(', "list": ['), (k % 3).cast("string"), F.lit(', null, {"deep": [true, "a b", '), (k % 7).cast("string"), F.lit('.5]}], "odd key": {}}'))
    return table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("doc"))


@query(f"""WITH {DOC} SELECT event_id, t.key, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'real' WHEN 'BOOLEAN' THEN t.value::VARCHAR ELSE 'integer' END AS type,
 CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN t.value ->> '$' END AS atom, t.fullkey, t.path FROM d, json_tree(d.doc) t""")
def json_nodes(spark, sf_dir):
    """Every node of every event's JSON text."""
    return jsontree.json_tree(nested_events(spark, sf_dir).select("event_id", "doc"), "doc")


@query(f"""WITH {DOC} SELECT event_id, json_merge_patch(doc, '{{"p": null, "list": {{"k": [1]}}, "odd key": {{"n": ' || event_id || ', "gone": null}}}}')::VARCHAR AS doc FROM d""")
def json_patched(spark, sf_dir):
    d = nested_events(spark, sf_dir)
    patch = F.concat(F.lit('{"p": null, "list": {"k": [1]}, "odd key": {"n": '), F.col("event_id").cast("string"), F.lit(', "gone": null}}'))
    return d.select("event_id", jsontree.json_patch("doc", patch).alias("doc"))


@query("SELECT user_id, to_json(list(event_type ORDER BY event_id))::VARCHAR AS types, '{' || string_agg(to_json(event_type || event_id) || ':' || (event_id % 9), ',' ORDER BY event_id) || '}' AS marks FROM events GROUP BY 1")
def json_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.concat("event_type", F.col("event_id").cast("string")).alias("name"), (F.col("event_id") % 9).alias("mark"))
    return e.groupBy("user_id").agg(jsontree.group_array("event_type", "event_id").alias("types"), jsontree.group_object("name", "mark", "event_id").alias("marks"))
