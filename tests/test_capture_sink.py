"""The capture sink: one capture for each run, however often it is written and wherever a write stops."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from voltlane.sources import capture, recordings

ROWS = "run_id string, seq long, recv_s double, raw string"


@pytest.fixture
def messages(spark):
    spark.dataSource.register(capture.CaptureSink)
    rows = [(run, k, 1000 + k * 0.25, f'{{"seq": {k}, "run": "{run}"}}') for run in ("a/1", "b") for k in range(200)]
    return spark.createDataFrame(rows[::-1], ROWS).repartition(3)


def read(spark, path):
    return sorted((os.path.basename(r.run_id), r.recv_s, r.raw) for r in recordings.live_capture(spark, f"{path}/*.live.tsv.gz").collect())


def test_a_repeated_write_gives_one_capture(spark, messages, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        capture.write_captures(messages, path)
        assert sorted(os.listdir(path)) == ["a%2F1.capture.json", "a%2F1.live.tsv.gz", "b.capture.json", "b.live.tsv.gz"]
    rows = {r.run_id: r for r in capture.catalog_rows(spark, path).collect()}
    for run, r in rows.items():
        with open(f"{path}/{r.file}", "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r.sha256
        assert (r.n, r.first_s, r.last_s) == (200, 1000.0, 1049.75)
    back = read(spark, path)
    assert [x[2] for x in back if x[0].startswith("b")] == [f'{{"seq": {k}, "run": "b"}}' for k in range(200)]


def test_a_failed_write_leaves_what_was_there(spark, messages, tmp_path):
    path = str(tmp_path / "out")
    capture.write_captures(messages.where("seq < 50"), path)
    before = read(spark, path)
    # a run whose last message cannot be read
    broken = messages.withColumn("raw", F.when(F.col("seq") < 199, F.col("raw")).otherwise(F.raise_error(F.lit("gone")).cast("string")))
    with pytest.raises(Exception, match="gone"):
        broken.select("run_id", "seq", "recv_s", "raw").repartition("run_id").sortWithinPartitions("run_id", "seq").write.format("capture").mode("append").save(path)
    assert read(spark, path) == before and not [f for f in os.listdir(path) if f.startswith(".") and f.endswith(".tmp")]


def test_a_killed_attempt_is_cleared_by_the_next(spark, messages, tmp_path):
    path = str(tmp_path / "out")
    killed = capture.CaptureWriter({"path": path})
    killed.write(iter(messages.where("run_id = 'b'").orderBy("seq").limit(5).collect()))  # never committed
    assert len(os.listdir(path)) == 1 and not [f for f in os.listdir(path) if not f.startswith(".")]
    capture.write_captures(messages, path)
    assert sorted(os.listdir(path)) == ["a%2F1.capture.json", "a%2F1.live.tsv.gz", "b.capture.json", "b.live.tsv.gz"]


def test_messages_of_several_lines_are_refused(spark, messages, tmp_path):
    with pytest.raises(ValueError):
        capture.write_captures(messages.withColumn("raw", F.lit("a\nb")), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")
