"""Answers of guarded SQL whatever a query does, and interval joins over sparse seqs."""

import random
import struct
import time

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from voltlane.operators import intervals, sqltool
from voltlane.sources.recordings import cdr_string


def test_syntax_errors_and_java_errors_are_answers(spark):
    for bad in ("select 1; select 2", "selec 1", "select", "select 'x", "select 1 / 0", "select cast('x' as int)", "select nope"):
        got = sqltool.run(spark, bad, [])
        assert set(got) == {"error"} and got["error"].strip() and not got["error"].startswith("--"), (bad, got)


def test_raw_java_errors_have_a_reason(spark):
    with pytest.raises(Py4JJavaError) as e:
        spark._jvm.java.util.ArrayList().get(41)
    assert "41" in sqltool.first_line(e.value)
    assert sqltool.first_line(ValueError("\n\n odd ")) == "odd" and sqltool.first_line(KeyError()) == "KeyError"


def test_a_long_query_is_stopped_in_time(spark):
    spark.range(2_000_000).createOrReplaceTempView("long")
    spark.range(20_000).createOrReplaceTempView("other")
    began = time.time()
    got = sqltool.run(spark, "select count(*) from long a join other b on a.id % 7 <> b.id % 5 where sqrt(a.id * b.id) > 3", ["long", "other"], seconds=3)
    assert time.time() - began < 6 and "stopped after 3 s" in got["error"]
    assert sqltool.run(spark, "select count(*) as n from long", ["long"])["rows"] == [{"n": 2_000_000}]


def test_results_are_capped_by_bytes_rows_and_cells(spark):
    spark.range(500).selectExpr("id", "repeat('y', 1500) as s").createOrReplaceTempView("wide")
    got = sqltool.run(spark, "select * from wide order by id", ["wide"], most_bytes=20_000)
    assert got["truncated"] and 5 <= len(got["rows"]) <= 13 and got["rows"][0]["id"] == 0
    got = sqltool.run(spark, "select cast('abc' as binary) b, cast(repeat('z', 40) as binary) c, double('nan') d, double('inf') e, 1.5D f, array(1, 2) g", [])
    assert got["rows"] == [{"b": "<blob 3 bytes: 616263>", "c": "<blob 40 bytes: " + "7a" * 16 + "...>", "d": None, "e": None, "f": 1.5, "g": "[1,2]"}]
    got = sqltool.run(spark, "select 1 as a, 2 as a", [])
    assert got["rows"] == [[1, 2]] and got["columns"] == ["a", "a"]


def test_recursion_and_types_are_allowed_within_limits(spark):
    got = sqltool.run(spark, "with recursive r(n) as (select 1 union all select n + 1 from r where n < 20) select sum(n) as s, max(typeof(n)) as t from r", [])
    assert got.get("rows") == [{"s": 210, "t": "int"}], got
    assert "error" in sqltool.run(spark, "with recursive r(n) as (select 1 union all select n + 1 from r) select count(*) from r", [])


def test_catalog_sql(spark):
    tables = {"recordings": spark.createDataFrame([("a", 1), ("b", 2)], "recording_id string, size long"), "secret": spark.range(1)}
    assert sqltool.catalog_sql(spark, tables, "select sum(size) as s from recordings")["rows"] == [{"s": 3}]
    assert "error" in sqltool.catalog_sql(spark, tables, "select * from secret")


def test_cdr_string_in_sql_equals_the_column(spark):
    sqltool.register_functions(spark)
    cells = [None, b"", b"\0\1\0\0" + struct.pack("<I", 4) + b"abc\0", b"\0\0\0\0" + struct.pack(">I", 6) + "déé".encode()[:5] + b"\0", b"\0\1\0\0" + struct.pack("<I", 99) + b"x"]
    spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in enumerate(cells)], "k long, data binary").createOrReplaceTempView("cdr")
    want = [r[0] for r in spark.table("cdr").orderBy("k").select(cdr_string(F.col("data"))).collect()]
    assert [r["v"] for r in sqltool.run(spark, "select cdr_string(data) as v from cdr order by k", ["cdr"])["rows"]] == want
    assert want[2] == "abc"


@pytest.mark.parametrize("block", [4, 512])
def test_rows_within_matches_brute_force(spark, block):
    rng = random.Random(block)
    seqs = sorted({rng.choice([rng.randrange(-50, 400), rng.randrange(10**11), -(10**15) + rng.randrange(9), 2**62 + rng.randrange(99)]) for _ in range(150)})
    rows = [(run, s, f"{run}{s}") for run in "ab" for s in seqs]
    spans = [(k, rng.choice("ab"), *sorted((rng.choice(seqs) + rng.randrange(-2, 3), rng.choice(seqs)))) for k in range(60)] + [(99, "a", 5, 4)]
    got = intervals.rows_within(spark.createDataFrame(rows, "run_id string, seq long, tag string"), spark.createDataFrame(spans, "k long, run_id string, start_seq long, end_seq long"), block=block).collect()
    want = [(k, run, s) for k, run, a, b in spans for r, s, _ in rows if r == run and a <= s <= b]
    assert sorted((r.k, r.run_id, r.seq) for r in got) == sorted(want)


def test_a_sparse_interval_costs_nine_blocks(spark):
    rows = spark.range(100).selectExpr("'r' as run_id", "id * 1000000000 as seq")
    span = spark.createDataFrame([("r", 0, 10**11)], "run_id string, start_seq long, end_seq long")
    intervals.rows_within(rows, span).count()
    began = time.time()
    assert intervals.rows_within(rows, span).count() == 100
    assert time.time() - began < 5


def test_nearest_place_over_the_date_line(spark):
    points = spark.createDataFrame([(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 10.0, 0.0)], "point_id long, lat double, lon double")
    places = spark.createDataFrame([(7, 10.0, -179.9995, 500.0)], "place_id long, p_lat double, p_lon double, radius_m double")
    assert sorted((r.point_id, r.place_id) for r in intervals.nearest_within(points, places).collect()) == [(1, 7), (2, 7), (3, None)]
