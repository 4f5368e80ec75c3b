"""Readers of recordings: bags, flat CSV, live captures, metadata and tracks.

All bytes come through Spark's own readers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQLITE_MAGIC = b"SQLite format 3\x00"
BAG_ROWS = "path string, topic string, type string, id long, ts double, data binary"


def containers(spark: SparkSession, path: str) -> DataFrame:
    """path, length and kind (bag, live capture, csv or other) of files, by content first and name second."""
    files = spark.read.format("binaryFile").load(path)
    magic = F.substring("content", 1, 16) == F.lit(SQLITE_MAGIC)
    kind = F.when(magic, "bag").when(F.col("path").endswith(".live.tsv.gz"), "live capture").when(F.lower("path").endswith(".csv"), "csv").otherwise("other")
    return files.select("path", "length", kind.alias("kind"))


def bag_messages(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Messages of bag files in id order within a file; a bag is one task (a split bag is several files).

    A topic is known with and without its leading slash. The file is opened from memory, so
    no local copy is made."""
    wanted = {t.lstrip("/") for t in topics} if topics else None

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                found = {i: (n, t) for i, n, t in db.execute("select id, name, type from topics") if wanted is None or n.lstrip("/") in wanted}
                rows = db.execute("select topic_id, id, timestamp, data from messages order by id")
                while part := rows.fetchmany(5000):
                    part = [r for r in part if r[0] in found]
                    if part:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(part)), pa.array([found[r[0]][0] for r in part]), pa.array([found[r[0]][1] for r in part]), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] / 1e9 for r in part], pa.float64()), pa.array([r[3] for r in part], pa.binary())],
                            names=["path", "topic", "type", "id", "ts", "data"],
                        )
                db.close()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, BAG_ROWS)


def bag_streams(messages: DataFrame) -> DataFrame:
    return messages.groupBy("path", "topic", "type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def bag_topics(spark: SparkSession, path: str) -> DataFrame:
    """path, topic, type, n, first_ts, last_ts of every topic of bags, those without messages too (n is 0)."""

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                rows = db.execute("select t.name, t.type, count(m.id), min(m.timestamp) / 1e9, max(m.timestamp) / 1e9 from topics t left join messages m on m.topic_id = t.id group by t.id").fetchall()
                db.close()
                topic, kind, n, first, last = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(topic, pa.string()), pa.array(kind, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.float64()), pa.array(last, pa.float64())], names=["path", "topic", "type", "n", "first_ts", "last_ts"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, topic string, type string, n long, first_ts double, last_ts double")


def cdr_string(data: Column) -> Column:
    """The string of a CDR-encoded std_msgs/String, or null: endian flag in byte 2, length at 5, text at 9, one NUL off."""
    four = F.hex(F.substring(data, 5, 4))
    turned = F.concat(F.substring(four, 7, 2), F.substring(four, 5, 2), F.substring(four, 3, 2), F.substring(four, 1, 2))
    little = F.conv(F.hex(F.substring(data, 2, 1)), 16, 10).cast("int") % 2 == 1
    size = F.conv(F.when(little, turned).otherwise(four), 16, 10).cast("long")
    body = F.make_valid_utf8(F.substring(data, F.lit(9), size.cast("int")).cast("string"))
    enough = (F.octet_length(data) >= 9) & (size >= 1) & (F.octet_length(data) >= size + 8)
    return F.when(enough, F.regexp_replace(body, "\\x00$", ""))


def bag_payloads(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """run_id (the file), seq, ts, raw: decodable strings of one topic."""
    m = bag_messages(spark, path, [topic]).where("type = 'std_msgs/msg/String'")
    return m.select(F.col("path").alias("run_id"), F.col("id").alias("seq"), "ts", cdr_string(F.col("data")).alias("raw")).where("raw is not null")


def csv_payloads(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the file), seq, ts, raw of flat CSV: a `timestamp` column in integer ns, dotted leaves otherwise.

    Numeric cells go into the JSON as they stand, others as strings, so that strict
    validation sees what the file holds. A row without an integer timestamp has ts null."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=False)
    leaves = [c for c in rows.columns if c != "timestamp"]

    def cell(c: str) -> Column:
        v = F.trim(F.col(f"`{c}`"))
        number = v.rlike(r"^-?\d+(\.\d*)?([eE][-+]?\d+)?$")
        odd = F.when(v.rlike("^(?i)nan$"), "NaN").when(v.rlike(r"^(?i)[+]?inf(inity)?$"), "Infinity").when(v.rlike(r"^(?i)-inf(inity)?$"), "-Infinity")
        return F.coalesce(F.when(number, v), odd, F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2), F.lit("null"))

    def tree(names: list[tuple[str, str]]) -> Column:
        groups: dict[str, list[tuple[str, str]]] = {}
        for full, rest in names:
            groups.setdefault(rest.split(".", 1)[0], []).append((full, rest.split(".", 1)[1] if "." in rest else ""))
        parts = [F.concat(F.lit(f'"{k}": '), cell(v[0][0]) if not v[0][1] else tree(v)) for k, v in groups.items()]
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))

    stamp = F.when(F.col("timestamp").rlike(r"^-?\d+$"), F.col("timestamp").try_cast("double") / 1e9) if "timestamp" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.input_file_name().alias("run_id"), F.monotonically_increasing_id().alias("seq"), stamp.alias("ts"), tree([(c, c) for c in leaves]).alias("raw"))


def live_capture(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the file), seq, recv_s, raw of gzipped captures: receive time, tab, message."""
    lines = spark.read.text(path).select(F.input_file_name().alias("run_id"), F.monotonically_increasing_id().alias("seq"), F.split("value", "\t", 2).alias("p"))
    return lines.select("run_id", "seq", F.element_at("p", 1).try_cast("double").alias("recv_s"), F.try_element_at("p", F.lit(2)).alias("raw"))


def loose_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Any CSV whose columns are named freely: names are compared by letters and digits; the first filled alias wins.

    Position needs both coordinates, power both voltage and current (keys lat, lon, voltage, current)."""
    rows = spark.read.csv(path, header=True)
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in rows.columns}

    def first(names: list[str]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{plain[n]}`")), F.lit("")).try_cast("double") for n in ("".join(ch for ch in a.lower() if ch.isalnum()) for a in names) if n in plain]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    out = rows.select(F.monotonically_increasing_id().alias("seq"), *[first(a).alias(k) for k, a in aliases.items()])
    for a, b in (("lat", "lon"), ("voltage", "current")):
        if a in aliases and b in aliases:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            out = out.withColumns({a: F.when(both, F.col(a)), b: F.when(both, F.col(b))})
    return out


def sql_csv(spark: SparkSession, path: str, view: str = "csv") -> DataFrame:
    """A CSV file as a temp view with inferred types; ragged rows are padded or cut, blank names become col0, col1, ..."""
    raw = spark.read.csv(path, header=True, inferSchema=True, mode="PERMISSIVE", nanValue="nan")
    named = raw.toDF(*[c if c.strip() and not c.startswith("_c") else f"col{i}" for i, c in enumerate(raw.columns)])
    named.createOrReplaceTempView(view)
    return named


def track(spark: SparkSession, path: str) -> DataFrame:
    """Gates of a JSON track definition ({"segments": [{"kind", "name", "aliases", "length_m", "gate": [lat, lon, lat, lon]}]}), in order."""
    kind = "segments array<struct<segment_id:int,kind:string,name:string,aliases:array<string>,length_m:double,gate:array<double>>>"
    s = spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("segments").alias("ordinal", "s"))
    gate = [F.element_at("s.gate", k + 1).alias(n) for k, n in enumerate(("gate_lat1", "gate_lon1", "gate_lat2", "gate_lon2"))]
    return s.select("ordinal", F.coalesce("s.segment_id", F.col("ordinal") + 1).alias("segment_id"), "s.kind", "s.name", "s.aliases", "s.length_m", *gate)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, at (line), key and value of `key: value` lines of metadata.yaml files; nested keys are joined by dots.

    A line belongs to the nearest line above it that is indented less; `- ` before a key counts as indentation."""
    part = lambda k: F.regexp_extract("line", r"^((?:\s|- )*)([\w.-]+):(?:\s+(.*))?$", k)
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    m = lines.select("path", "at", F.length(part(1)).alias("pad"), part(2).alias("key"), F.trim(part(3)).alias("value")).where("key <> ''")
    # the keys above each line, nearest last: those of less indentation than all that follow
    above = F.collect_list(F.struct("pad", "key")).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    stack = F.struct(F.col("pad").alias("least"), F.array().cast("array<string>").alias("keys"))
    climb = lambda acc, x: F.when(x["pad"] < acc["least"], F.struct(x["pad"].alias("least"), F.concat(F.array(x["key"]), acc["keys"]).alias("keys"))).otherwise(acc)
    parents = F.aggregate(F.reverse(above), stack, climb, lambda acc: acc["keys"])
    return m.withColumn("key", F.concat_ws(".", parents, F.col("key"))).where("value <> ''").select("path", "at", "key", F.regexp_replace("value", "^['\"]|['\"]$", "").alias("value"))
