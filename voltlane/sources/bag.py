"""Bags as a Spark data source: partitions by ranges of message ids, filters pushed down, and streams by id.

    spark.dataSource.register(BagSource)
    spark.read.format("bag").option("rows", 100_000).load("/mnt/bags/*.db3").where("topic = '/spi_data'")
    spark.readStream.format("bag").load("/mnt/bags/growing.db3")

A bag is an SQLite file, so workers must be able to open it where it lies (a mounted folder);
each partition seeks to its first id and reads on in blocks, so memory does not grow with the
bag. Bags in stores that only Spark reads go through `recordings.bag_messages`, one task each.

Topics of no message have no row (`recordings.bag_topics` lists them). A file that is no bag, or
one without the two tables, is an error that names it. Filters on topic, id and ts are applied
in SQL where `spark.sql.python.filterPushdown.enabled` is on; others are Spark's.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voltlane.sources.recordings import BAG_ROWS

#: Messages of a partition, and of a block that is read at once.
ROWS, BLOCK = 100_000, 2_000
SELECT = "SELECT t.name, t.type, m.id, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id WHERE m.id > ? AND m.id <= ?"
ARROW = pa.schema([("path", pa.string()), ("topic", pa.string()), ("type", pa.string()), ("id", pa.int64()), ("ts", pa.float64()), ("data", pa.binary())])
COMPARED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}


@dataclass
class IdRange(InputPartition):
    """Messages of one file with after < id <= upto."""

    path: str
    after: int
    upto: int


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def ids(path: str) -> tuple[int, int]:
    """The first and the last message id of a bag; (1, 0) if it has none."""
    try:
        db = opened(path)
        try:
            low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
        finally:
            db.close()
    except sqlite3.DatabaseError as e:
        raise ValueError(f"{path} is not a bag: {e}") from e
    return (1, 0) if low is None else (low, high)


def files(options: dict) -> list[str]:
    path = options.get("path", "").removeprefix("file:")
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(f"no bag at {path!r}")
    return found


def ranges(path: str, after: int, upto: int, rows: int) -> list[IdRange]:
    return [IdRange(path, a, min(a + rows, upto)) for a in range(after, upto, rows)]


def messages(part: IdRange, where: list[tuple[str, list]]) -> Iterator[pa.RecordBatch]:
    """The partition's messages in id order, block by block."""
    db = opened(part.path)
    try:
        values = [part.after, part.upto, *(v for _, more in where for v in more)]
        rows = db.execute(" AND ".join([SELECT, *(sql for sql, _ in where)]) + " ORDER BY m.id", values)
        while block := rows.fetchmany(BLOCK):
            topic, kind, at, ns, data = zip(*block, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(block)), pa.array(topic), pa.array(kind), pa.array(at, pa.int64()), pa.array([n / 1e9 for n in ns], pa.float64()), pa.array(data, pa.binary())], schema=ARROW)
    finally:
        db.close()


class BagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.rows, self.where = files(options), int(options.get("rows", ROWS)), []

    def pushFilters(self, filters):
        for f in filters:
            column = {("topic",): "t.name", ("id",): "m.id", ("ts",): "m.timestamp / 1e9"}.get(getattr(f, "attribute", None))
            if column and isinstance(f, In):
                self.where.append((f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column and type(f) in COMPARED:
                self.where.append((f"{column} {COMPARED[type(f)]} ?", [f.value]))
            else:
                yield f

    def partitions(self):
        parts = []
        for path in self.paths:
            low, high = ids(path)
            parts += ranges(path, low - 1, high, self.rows)
        return parts or [IdRange(self.paths[0], 0, 0)]

    def read(self, partition):
        return messages(partition, self.where)


class BagStream(DataSourceStreamReader):
    """New messages of bags that grow; the offset is the last id read of each file."""

    def __init__(self, options: dict):
        self.options, self.rows = options, int(options.get("rows", ROWS))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {path: ids(path)[1] for path in files(self.options)}

    def partitions(self, start, end):
        return [part for path, upto in sorted(end.items()) for part in ranges(path, start.get(path, ids(path)[0] - 1), upto, self.rows)]

    def read(self, partition):
        return messages(partition, [])

    def commit(self, end):
        pass


class BagSource(DataSource):
    @classmethod
    def name(cls):
        return "bag"

    def schema(self):
        return BAG_ROWS

    def reader(self, schema):
        return BagReader(self.options)

    def streamReader(self, schema):
        return BagStream(self.options)
