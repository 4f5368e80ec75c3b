import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from test_telemetry import bag

from voltlane.functions.payload import flat_columns
from voltlane.operators import catalog, ingest, intervals, library, search, sqltool, tools


@pytest.mark.parametrize("module", ["voltlane.plans.telemetry", "voltlane.plans.documents", "voltlane.operators.track", "voltlane.streaming.live"])
def test_any_module_can_be_imported_first(module):
    run = subprocess.run([sys.executable, "-c", f"import {module}; print('fine')"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert "fine" in run.stdout, run.stderr


def test_nested_intervals_come_back(spark):
    rows = spark.createDataFrame([("r", i) for i in range(12)], "run_id string, seq long")
    inner = spark.createDataFrame([("r", "outer", 1, 10), ("r", "in", 3, 5), ("r", "late", 9, 11), ("r", "none", 7, 7)], "run_id string, name string, start_seq long, end_seq long")
    got = [r["name"] for r in intervals.interval_of(rows, inner, "name").orderBy("seq").collect()]
    assert got == [None, "outer", "outer", "in", "in", "outer", "outer", "outer", "outer", "late", "late", None]
    pairs = {(r["name"], r["seq"]) for r in intervals.rows_within(rows, inner, block=4).collect()}
    assert pairs == {(n, s) for n, a, b in (("outer", 1, 10), ("in", 3, 5), ("late", 9, 11), ("none", 7, 7)) for s in range(a, b + 1)}


def test_repository_files_that_are_read(spark):
    cases = {
        "README": True, "a/readme.MD": True, "src/notes.txt": True, "data/run.csv": True, "docs/conf.yaml": True, "conf.yaml": False, "package.json": False, "docs/package-lock.json": False, "vendor/a.md": False, "Build/README.md": False,
        ".github/a.md": False, "a/.hidden.md": False, "LICENSE": False, "license.txt": False, "app.min.txt": False, "requirements-dev.txt": False, "CMakeLists.txt": False, "main.py": False, "wiki/x.json": True, "a/b.rst": True,
    }
    got = spark.createDataFrame([(k, 10) for k in cases], "path string, size long").select("path", library.readable(F.col("path"), F.col("size")).alias("ok")).collect()
    assert {r["path"]: r["ok"] for r in got} == cases
    sizes = spark.createDataFrame([("a.md", None), ("a.md", 0), ("a.md", 200 * 1024), ("a.md", 200 * 1024 + 1)], "path string, size long")
    assert [r[0] for r in sizes.select(library.readable(F.col("path"), F.col("size"))).collect()] == [False, False, True, False]


def test_embedding_texts(spark):
    row = spark.range(1).select(
        library.embedding_text("other", F.lit("T"), F.array(*map(F.lit, "abc")), F.lit("H"), F.lit("body ")).alias("plain"), library.embedding_text("embeddinggemma-300m", F.lit("T"), F.array(F.lit("a")), F.lit(""), F.lit("x" * 9000)).alias("cut"),
        library.embedding_question("embeddinggemma", F.lit("q")).alias("q"), library.embedding_question("other", F.lit("q")).alias("same"),
    ).first()
    assert row["plain"] == "b > c > T > H\nbody" and row["cut"].startswith("title: T | text: a > T\nxxx") and len(row["cut"]) == 6000
    assert row["q"] == "task: search result | query: q" and row["same"] == "q"


def test_streams_and_headers_are_matched_by_content(spark):
    good = '{"seq": 1, "global_ts": 1, "_t_publish_ns": 1, "power": {"ts": 1, "current": 1, "voltage": 1}, "steering": {"ts": 1, "brake_pressure": 0, "turn_angle": 0}, "rpm_front": {"ts": 0, "rpm_left": 0, "rpm_right": 0}, "rpm_back": {"ts": 0, "rpm_left": 0, "rpm_right": 0}, "gps": {"ts": 0, "lat": 0, "long": 0, "heading": 0, "speed": 0}, "motor": {"ts": 0, "rpm": 0, "throttle": 0}, "filtered": {"speed": 0}}'
    rows = [("a", s, i, g) for s, g in (("/x", "no"), ("/telemetry", good), ("/copy", good)) for i in range(3)] + [("b", "/x", 0, "[]")]
    got = {(r["recording_id"], r["stream"]): (r["schema"], r["matched"]) for r in ingest.match_streams(spark.createDataFrame(rows, "recording_id string, stream string, seq long, raw string")).collect()}
    assert got == {("a", "/x"): (None, False), ("a", "/telemetry"): ("telemetry.v1", False), ("a", "/copy"): ("telemetry.v1", True), ("b", "/x"): (None, False)}
    v2 = sorted(flat_columns("telemetry.v2"))
    heads = {r["file"]: r for r in ingest.header_match(spark.createDataFrame([("ok", v2), ("near", [*v2[1:], "odd"]), ("twice", [*v2, v2[0]])], "file string, header array<string>")).collect()}
    assert heads["ok"]["schema"] == "telemetry.v2" and heads["near"]["schema"] is None and heads["near"]["closest"] == "telemetry.v2" and heads["near"]["extra"] == ["odd"] and heads["near"]["missing"] == [v2[0]]
    assert heads["twice"]["schema"] is None


def test_gps_box_and_csv_range(spark):
    fixes = spark.createDataFrame([("r", 1.0, 2.0), ("r", 0.0, 0.0), ("r", None, 5.0), ("r", -1.0, 7.0), ("s", 0.0, 0.0)], "run_id string, lat double, lon double")
    assert [tuple(r) for r in catalog.gps_box(fixes).collect()] == [("r", -1.0, 1.0, 2.0, 7.0, 2)]
    rows = spark.createDataFrame([("f", 1.5), ("f", None), ("f", 0.5), ("g", None)], "run_id string, ts double")
    assert sorted(tuple(r) for r in catalog.csv_time_range(rows).collect()) == [("f", 0.5, 1.5, 3), ("g", None, None, 1)]


def test_sql_over_a_recording(spark, tmp_path):
    path = str(tmp_path / "a.db3")
    bag(path, ["one", "two"])
    got = sqltool.query_recording(spark, path, "select t.topic, count(*) n, max(m.text) last from topics t join messages m using (topic) where t.topic = '/telemetry' group by 1")
    assert got["rows"] == [{"topic": "/telemetry", "n": 3, "last": "two"}]
    assert "error" in sqltool.query_recording(spark, path, f"select * from binaryFile.`{path}`") and dict(sqltool.recording_schema(spark, path)["messages"])["ts"] == "double"
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    assert sqltool.query_recording(spark, str(tmp_path / "x.csv"), "select sum(a) s from csv")["rows"] == [{"s": 3}]


def test_search_end_to_end(spark):
    page = "page_id string, source string, kind string, title string, breadcrumb array<string>, url string, updated string, empty boolean"
    pages = spark.createDataFrame([
        ("p1", "confluence", "page", "Brake guide", ["Mech"], "u1", "2026-01-01T00:00:00", False), ("p2", "confluence", "page", "Brakes", ["Mech"], "u2", None, True), ("d1", "drive", "drive_doc", "brake plan.pdf", ["x"], "u3", None, False),
        ("d2", "drive", "drive_doc", "Copy of brake plan", ["x"], "u4", None, False), *[(f"g{k}", "github", "repo_doc", f"brake{k}.md", ["org", "car", "lib", str(k)], "u", None, False) for k in range(4)],
    ], page)
    words = {"p1": "how to bleed the brake lines and check the brake pads", "p2": "", "d1": "brake plan for the season", "d2": "brake plan for the season", **{f"g{k}": "brake code " * (k + 1) for k in range(4)}}
    sections = spark.createDataFrame([(i, p, "H", t) for i, (p, t) in enumerate(words.items())], "doc_id long, page_id string, heading string, text string")
    asked = spark.createDataFrame([(1, "brake bleed"), (2, "nothing like it")], "query_id long, q string")
    now = F.lit("2026-06-01").cast("timestamp")
    hits = search.search(pages, sections, asked, now, 10).orderBy("query_id", "place").collect()
    found = [r["page_id"] for r in hits]
    assert found[0] == "p1" and sum(f[0] == "d" for f in found) == 1 and sum(f[0] == "g" for f in found) == 2 and {r["query_id"] for r in hits} == {1}
    assert [r["page_id"] for r in search.search(pages, sections, asked, now, 10, ["github"]).collect()] and all(r["source"] == "github" for r in search.search(pages, sections, asked, now, 10, ["github"]).collect())
    v = spark.createDataFrame([(0, [0.0, 1.0]), (4, [1.0, 0.0])], "doc_id long, v array<double>")
    near = spark.createDataFrame([(2, [1.0, 0.1])], "query_id long, v array<double>")
    both = search.search(pages, sections, asked, now, 3, vectors=v, query_vectors=near).where("query_id = 2").orderBy("place").collect()
    assert both[0]["doc_id"] == 4
    links = spark.createDataFrame([(0, 0, "d1", "L", "see"), (0, 1, "zz", "L2", ""), (0, 2, "d9", "L3", "named")], "doc_id long, at int, file_id string, url string, text string")
    more = {r["file_id"]: (r["title"], r["url"], r["via"]) for r in search.linked_files(spark.createDataFrame([r for r in hits if r["page_id"] == "p1"], search.search(pages, sections, asked, now).schema), links, pages).collect()}
    assert more == {"d1": ("brake plan.pdf", "u3", "p1"), "zz": ("linked file", "L2", "p1"), "d9": ("named", "L3", "p1")}


def test_everything_of_a_run_is_derived_anew(spark):
    from test_telemetry import at, ring

    gates = [(k, "turn", f"T{k}", *at(*[c + o for c, o in zip(ring(150 * k + 1), (0, -40) if k in (0, 1, 4) else (-40, 0), strict=True)]), *at(*[c + o for c, o in zip(ring(150 * k + 1), (0, 40) if k in (0, 1, 4) else (40, 0), strict=True)])) for k in range(6)]
    g = spark.createDataFrame(gates, "ordinal int, kind string, name string, gate_lat1 double, gate_lon1 double, gate_lat2 double, gate_lon2 double")
    rows = [("r", i, float(i), 0.5, *at(*ring(10.0 * i)), float(i)) for i in range(200)]
    s = spark.createDataFrame(rows, "run_id string, seq long, t double, p double, lat double, lon double, fix_t double")
    done = tools.reclassify(s, g, (*at(0.0, 0.0), 25.0))
    assert done["run_summary"].count() == 1 and done["laps"].count() >= 1 and done["segments"].count() >= 6
    assert [r["name"] for r in tools.list_track_segments(g.withColumn("aliases", F.array())).collect()] == [f"T{k}" for k in range(6)]
