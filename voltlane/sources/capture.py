"""Captures of live runs as a Spark data sink: one gzipped file for each run, committed as a whole, once.

    spark.dataSource.register(CaptureSink)
    write_captures(messages, "/mnt/captures")

Tasks write their runs to hidden files; only the driver's commit gives them their names, by a
rename that replaces an earlier capture of the same run. A write that is killed leaves no
capture, a repeated one leaves one, and a failed one takes its files away. Each capture has a
row (`catalog_rows`) with its size, hash and time range, written with the same rename.

The folder must be one that all workers mount; `sinks.write_capture` writes through Spark's own
writers to any store, without the commit.
"""

from __future__ import annotations

import glob
import gzip
import hashlib
import json
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

END = ".live.tsv.gz"
MANIFEST = "run_id string, file string, n long, size_bytes long, sha256 string, first_s double, last_s double"


@dataclass
class Written(WriterCommitMessage):
    """Hidden files of one task: (hidden file, catalog row)."""

    runs: list[tuple[str, dict]] = field(default_factory=list)


class CaptureWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")
        # the same on all tasks, so that the driver can take away what a failed job left
        self.job = uuid.uuid4().hex

    def hidden(self, run: str) -> str:
        return os.path.join(self.path, f".{quote(run, safe='')}.{self.job}.{uuid.uuid4().hex}.tmp")

    def write(self, iterator) -> Written:
        """Rows of whole runs in order: run_id, seq, recv_s, raw."""
        os.makedirs(self.path, exist_ok=True)
        done, run, out = Written(), None, None
        for r in iterator:
            if out is None or r.run_id != run:
                if out:
                    self.finish(out, done, row)
                run, name = r.run_id, self.hidden(str(r.run_id))
                out = gzip.GzipFile(name, "wb", mtime=0)
                row = {"run_id": str(run), "file": quote(str(run), safe="") + END, "n": 0, "first_s": r.recv_s, "last_s": r.recv_s}
            out.write(f"{r.recv_s:.6f}\t{r.raw}\n".encode())
            row["n"] += 1
            row["last_s"] = r.recv_s
        if out:
            self.finish(out, done, row)
        return done

    @staticmethod
    def finish(out: gzip.GzipFile, done: Written, row: dict) -> None:
        out.close()
        digest = hashlib.sha256()
        with open(out.name, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        done.runs.append((out.name, row | {"size_bytes": os.path.getsize(out.name), "sha256": digest.hexdigest()}))

    def commit(self, messages) -> None:
        for name, row in (x for m in messages if m for x in m.runs):
            final = os.path.join(self.path, row["file"])
            os.replace(name, final)
            listed = f"{name}.json"
            with open(listed, "w") as f:
                json.dump(row, f)
            os.replace(listed, os.path.join(self.path, row["file"].removesuffix(END) + ".capture.json"))
            for left in glob.glob(os.path.join(glob.escape(self.path), f".{glob.escape(quote(row['run_id'], safe=''))}.*.tmp")):
                os.remove(left)  # of an attempt at this run that was killed

    def abort(self, messages) -> None:
        for left in glob.glob(os.path.join(glob.escape(self.path), f".*.{self.job}.*.tmp")):
            os.remove(left)


class CaptureSink(DataSource):
    @classmethod
    def name(cls):
        return "capture"

    def writer(self, schema, overwrite):
        return CaptureWriter(self.options)


def write_captures(messages: DataFrame, path: str) -> None:
    """Captures of all runs in `messages` (run_id, seq, recv_s, raw); a run is one task's file, in order of seq.

    Line ends inside a message would end its line: such messages are refused before anything is written."""
    if not messages.where("raw like '%\\n%' or raw is null or recv_s is null or run_id is null").isEmpty():
        raise ValueError("messages need run_id, recv_s and raw, and raw must be one line")
    whole = messages.select("run_id", "seq", "recv_s", "raw").repartition("run_id").sortWithinPartitions("run_id", "seq")
    whole.write.format("capture").mode("append").save(path)


def catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each capture: run_id, file, n, size_bytes, sha256, first_s, last_s."""
    return spark.read.schema(MANIFEST).json(f"{path}/*.capture.json")
