"""Sessions by cause, files of moments and JSON trees in their corners."""

import json

import pytest
from pyspark.sql import functions as F

from voltlane.operators import catalog, jsontree, sequence

ROWS = "run_id string, seq long, t double, bag_id string, device_seq long, device_t double, schema string"


def reasons(spark, rows, **options):
    return [(r.session, r.first_seq, r.n, r.end_reason) for r in sequence.sessions(spark.createDataFrame(rows, ROWS), **options).orderBy("session").collect()]


def row(seq, t, bag=None, dseq=None, dt=None, schema="v1"):
    return ("r", seq, float(t), bag, seq if dseq is None else dseq, float(t if dt is None else dt), schema)


def test_each_cause_ends_a_session_and_the_first_counts(spark):
    rows = [row(1, 0), row(2, 1), row(3, 100), row(4, 101, dseq=0, dt=5), row(5, 102, schema="v2"), row(6, 103, schema=None), row(7, 104, schema="v2"), row(8, 105, bag="b1", schema="v1"), row(9, 999, bag="b1", schema="v1"), row(10, 1000, schema="v1")]
    assert reasons(spark, rows) == [(1, 1, 2, "gap"), (2, 3, 1, "reboot"), (3, 4, 1, "schema"), (4, 5, 3, "bag"), (5, 8, 2, "bag"), (6, 10, 1, "open")]
    assert sequence.sessions(spark.createDataFrame([], ROWS)).count() == 0


def test_two_publishers_do_not_split_again_and_again(spark):
    rows = [row(k, k, dseq=100 + k if k % 2 else k, dt=100 + k if k % 2 else k) for k in range(1, 12)]
    assert len(reasons(spark, rows)) == 6  # every even row goes back
    assert reasons(spark, rows, holdoff_s=5.0) == [(1, 1, 1, "reboot"), (2, 2, 6, "reboot"), (3, 8, 4, "open")]


def test_files_of_own_and_other_sources(spark):
    rec = spark.createDataFrame([("own", "r1", 100.0, 200.0), ("cam", None, 190.0, 260.0), ("far", None, 5e6, 5e6 + 9), ("bare", "r2", None, None), ("touch", None, 50.0, 100.0)], "recording_id string, run_id string, recorded_start double, recorded_end double")
    files = spark.createDataFrame([(r, f"{r}.db3") for r in ("own", "cam", "far", "bare", "touch")] + [("cam", "cam.mp4")], "recording_id string, rel_path string")
    asks = spark.createDataFrame([(1, "r1", None, None), (2, "r1", 210.0, 220.0), (3, "r2", None, None), (4, "none", None, None), (5, "none", 5e6, 6e6)], "ask_id long, run_id string, start_ts double, end_ts double")
    got = {}
    for r in catalog.find_files(asks, rec, files).collect():
        got.setdefault(r.ask_id, []).append(r.rel_path)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["cam.db3", "cam.mp4", "own.db3", "touch.db3"], 2: ["cam.db3", "cam.mp4", "own.db3"], 3: ["bare.db3"], 5: ["far.db3"]}


def test_describe_recording(spark):
    rec = spark.createDataFrame([("a", 1, "{}"), ("b", None, "{}")], "recording_id string, location_id long, metadata_json string")
    streams = spark.createDataFrame([("a", "z", 5), ("a", "b", 7)], "recording_id string, stream string, n long")
    places = spark.createDataFrame([(1, "track")], "location_id long, name string")
    got = catalog.describe_recording(rec, streams, places, "a").first()
    assert got.location == "track" and [tuple(s) for s in got.streams] == [("b", 7), ("z", 5)] and "metadata_json" not in got
    assert catalog.describe_recording(rec, streams, places, "b").first().streams == [] and catalog.describe_recording(rec, streams, places, "x").count() == 0


def brute(value, key=None, full="$", path="$"):
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "text" if isinstance(value, str) else "null" if value is None else str(value).lower() if isinstance(value, bool) else "integer" if isinstance(value, int) else "real"
    atom = None if kind in ("object", "array", "null") else value if kind == "text" else json.dumps(value)
    yield key, kind, atom, full, path
    members = value.items() if kind == "object" else enumerate(value) if kind == "array" else ()
    for k, v in members:
        name = f"[{k}]" if kind == "array" else f".{k}" if k.isidentifier() and k.isascii() else f'."{k}"'
        yield from brute(v, str(k), full + name, full)


DOCS = ['{"a": [1, [2, {"b c": "x]["}]], "d": {}, "e": []}', "[]", "7", '"s"', "null", "true", '{"n": 1.5, "t": false, "z": null, "q": "\\"{"}', "[[[[[1]]]]]"]


def test_trees_match_a_walk(spark):
    rows = spark.createDataFrame([(k, d) for k, d in enumerate([*DOCS, None, "{bad", ""])], "k long, doc string")
    got = sorted((r.k, r.fullkey, r.key, r.type, r.atom, r.path) for r in jsontree.json_tree(rows, "doc").collect())
    assert got == sorted((k, full, key, kind, atom, path) for k, d in enumerate(DOCS) for key, kind, atom, full, path in brute(json.loads(d)))
    each = sorted((r.k, r.fullkey) for r in jsontree.json_each(rows, "doc").collect())
    assert each == sorted((k, full) for k, d in enumerate(DOCS) for _, kind, _, full, path in brute(json.loads(d)) if (full != "$" and path == "$") or (full == "$" and kind not in ("object", "array")))
    assert jsontree.json_tree(rows.limit(0), "doc").count() == 0


@pytest.mark.parametrize("target, patch, want", [('{"a":1}', '{"a":null}', "{}"), ('{"a":{"b":1}}', '{"a":{"c":[2]}}', '{"a":{"b":1,"c":[2]}}'), ("[1]", '{"a":1}', '{"a":1}'), ('{"a":1}', "[2]", "[2]"), ('{"é":1}', "{}", '{"é":1}'), (None, "{}", None), ("{bad", "{}", None)])
def test_merge_patches(spark, target, patch, want):
    assert spark.createDataFrame([(target, patch)], "t string, p string").select(jsontree.json_patch("t", "p")).first()[0] == want


def test_groups_in_order_with_odd_names(spark):
    rows = spark.createDataFrame([(1, 2, 'a"b', None), (1, 1, "z", "x"), (1, 3, None, "gone"), (1, 4, "z", "again")], "g long, o long, n string, v string")
    got = rows.groupBy("g").agg(jsontree.group_array("v", "o").alias("a"), jsontree.group_object("n", "v", "o").alias("o")).first()
    assert got.a == '["x",null,"gone","again"]' and got.o == '{"z":"x","a\\"b":null,"z":"again"}'
