"""Helpers shared by the training-data operators: table paths, the shared scratch
folder, bounded text blocks and vectorised word hashing over UTF-8 buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass looks at. A longer text is a block of its own.
BLOCK_BYTES = 1 << 19


#: Rows and bytes of one Arrow batch, where the session sets none: texts can be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table below `sf_dir`; the session's Arrow batches become small, unless it sets their size itself."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The session's setting wins. Only a session without a cluster may go without one: it makes a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base.rstrip('/')}/voltlane/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder: later reads survive lost executors and
    do not compute it again."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are broadcast to take rows out of a table, at most (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small(rows: DataFrame, what: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """`rows` as a table in the shared folder, to be broadcast if they are at most `limit`."""
    rows = written(rows, what)
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def without(docs: DataFrame, drop: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """`docs` without the rows whose doc_id is in `drop` (distinct doc_ids); null doc_ids stay."""
    ids = small(drop.select(F.col("doc_id").alias("__drop")), "drop", limit)
    return docs.join(ids, F.col("doc_id") == F.col("__drop"), "left_anti")


def in_training(doc_id: Column) -> Column:
    """True for the three quarters of the documents that models may learn from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def give_back() -> None:
    """Gives a worker's freed memory back to the machine: Spark keeps workers for the stages after, and what a worker
    holds is lost to them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable) -> Callable:
    """A mapInArrow function whose worker gives its memory back at the end of each task."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array with at most `limit` bytes, or one longer text. Nulls become ''."""
    texts = texts.fill_null("")
    _, offsets = utf8(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins (one more at the end)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def byte_class(chars: bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given bytes."""
    lut = np.zeros(256, bool)
    lut[np.frombuffer(chars, np.uint8)] = True
    return lut


SPACE = byte_class(b" \t\n\v\f\r")


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True bytes; no run crosses a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` over [offsets[i], offsets[i+1])."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class RollingHash:
    """64-bit hashes of any byte ranges of one buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _power(_INVERSE, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n successive entries of `h`, in order."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k])
    return out


def by_key(batches, columns: tuple[str, ...], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Lists of arrays that hold whole runs of equal keys; the rows are sorted by the first `keys` columns.

    A run is put together once, when it ends, however many batches it comes in."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(rows[0]):
            continue
        same = np.ones(len(rows[0]), bool)
        for x in rows[:keys]:
            same &= x == x[-1]
        last = int(same.argmax())
        if last or (held and any(h[-1] != x[0] for h, x in zip(held[-1][:keys], rows, strict=False))):
            held.append([x[:last] for x in rows])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([x[last:] for x in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
