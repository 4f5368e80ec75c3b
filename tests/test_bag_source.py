"""The bag data source against the whole-file reader: ranges of ids, pushed filters, streams that go on."""

import sqlite3

import pytest

from voltlane.sources import bag, recordings


def write(path, n, first=1, gap=1):
    db = sqlite3.connect(path)
    db.execute("create table if not exists topics (id integer primary key, name text, type text)")
    db.execute("create table if not exists messages (id integer primary key, topic_id integer, timestamp integer, data blob)")
    db.execute("insert or ignore into topics values (1, '/spi_data', 'std_msgs/msg/String'), (2, 'gps', 'x/Fix'), (3, '/silent', 'x/None')")
    db.executemany("insert into messages values (?, ?, ?, ?)", [(first + k * gap, 1 + k % 2, (1000 + k) * 10**9, bytes([k % 256]) * 5) for k in range(n)])
    db.commit()
    db.close()


@pytest.fixture
def bags(spark, tmp_path):
    spark.dataSource.register(bag.BagSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    write(tmp_path / "a.db3", 5000)
    write(tmp_path / "b.db3", 10, first=7, gap=1000)
    write(tmp_path / "c.db3", 0)
    return tmp_path


def rows(df):
    return sorted((r.path.rsplit("/", 1)[1], r.topic, r.type, r.id, r.ts, bytes(r.data)) for r in df.collect())


def test_same_rows_as_the_whole_file_reader(spark, bags):
    df = spark.read.format("bag").option("rows", 700).load(str(bags / "*.db3"))
    assert df.rdd.getNumPartitions() == 8 + 13  # 5000 ids, and 9001 ids of which ten are used
    assert rows(df) == rows(recordings.bag_messages(spark, str(bags / "*.db3")))
    assert df.count() == 5010


def test_filters_reach_the_file(spark, bags):
    df = spark.read.format("bag").load(str(bags / "a.db3"))
    part = df.where("topic = 'gps' and id > 100 and id <= 200 and ts < 1150 and length(data) = 5")
    assert rows(part) == [r for r in rows(df) if r[1] == "gps" and 100 < r[3] <= 200 and r[4] < 1150]
    reader = bag.BagReader({"path": str(bags / "a.db3")})
    left = list(reader.pushFilters([bag.EqualTo(("topic",), "gps"), bag.In(("id",), (3, 4)), bag.EqualTo(("type",), "x/Fix")]))
    assert [f.attribute for f in left] == [("type",)] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_blocks_bound_what_is_held(bags, monkeypatch):
    monkeypatch.setattr(bag, "BLOCK", 64)
    reader = bag.BagReader({"path": str(bags / "a.db3"), "rows": "1000"})
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert max(sizes) == 64 and sum(sizes) == 5000


def test_a_growing_bag_as_a_stream(spark, bags):
    path, out, ck = str(bags / "a.db3"), str(bags / "out"), str(bags / "ck")

    def drain():
        stream = spark.readStream.format("bag").option("rows", 900).load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start().awaitTermination(60)

    drain()
    write(path, 40, first=5001)
    drain()
    assert rows(spark.read.parquet(out)) == rows(spark.read.format("bag").load(path)) and spark.read.parquet(out).count() == 5040


def test_other_files_are_named(spark, bags):
    (bags / "x.db3").write_text("no bag at all, but long enough to be looked at" * 20)
    with pytest.raises(ValueError, match="x.db3 is not a bag"):
        bag.ids(str(bags / "x.db3"))
    with pytest.raises(FileNotFoundError, match="none.db3"):
        bag.files({"path": str(bags / "none.db3")})


def test_topics_without_messages(spark, bags):
    found = recordings.bag_topics(spark, str(bags / "[ac].db3")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.topic, r.n) for r in found) == [("a.db3", "/silent", 0), ("a.db3", "/spi_data", 2500), ("a.db3", "gps", 2500), ("c.db3", "/silent", 0), ("c.db3", "/spi_data", 0), ("c.db3", "gps", 0)]


def test_metadata_keys_are_joined_by_dots(spark, tmp_path):
    (tmp_path / "metadata.yaml").write_text("info:\n  version: 5\n  duration:\n    nanoseconds: '77'\n  topics:\n    - name: /gps\n      type: x/Fix\n    - name: /spi\nother: \"z\"\n")
    got = {(r.key, r.value) for r in recordings.metadata(spark, str(tmp_path / "metadata.yaml")).collect()}
    assert got == {("info.version", "5"), ("info.duration.nanoseconds", "77"), ("info.topics.name", "/gps"), ("info.topics.type", "x/Fix"), ("info.topics.name", "/spi"), ("other", "z")}
