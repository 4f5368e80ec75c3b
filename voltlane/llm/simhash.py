"""SimHash near-duplicates: fingerprints, a pigeonhole join on blocks, and components.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in three bits
or fewer agree on at least three whole blocks, so for one of the twenty choices of three
blocks they share a key of 31 to 33 bits. Distinct fingerprints meet under these keys,
their Hamming distance is verified, and each key's task hands on a spanning forest of
its links, never all pairs. A crowded key is cut again the same way over its free bits,
so the work stays near-linear and no link is lost.

Null and empty texts have fingerprint zero, which links like any other. Texts with fewer
words than a shingle give one shingle. Repeated rows fall into one class; very long texts
are hashed whole. An empty table gives an empty result. `classes` returns its own columns
only, whatever else the table has; `dedup` keeps all columns, and decides by doc_id and
fingerprint, so a repeated doc_id loses only what is linked elsewhere.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm.common import BROADCAST_IDS, by_key, lean, text_blocks, written

BITS, MAX_DISTANCE = 64, 3
SEED = 42
#: A key with more fingerprints than this is cut again over its free bits.
CROWDED = 4096


def shingles(text: bytes, size: int) -> list[bytes]:
    """Space-joined runs of `size` words; fewer words give one shingle, none give no shingle."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [line[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]


def fingerprint(text: bytes, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles(text, size)], np.uint64)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 16384):
        part = h[at : at + 16384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_udf(size: int = 3):
    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        at = 0
        for block in text_blocks(texts):
            for text in block.cast(pa.binary()).to_pylist():
                out[at] = fingerprint(text, size)
                at += 1
        return pa.array(out.view(np.int64))

    return simhash


def block_masks(free: int, blocks: int = 6, keep: int = 3) -> list[int]:
    """Masks of all choices of `keep` out of `blocks` runs of the bits set in `free`."""
    bits = [b for b in range(BITS) if free >> b & 1]
    runs = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)] if bits else [0] * blocks
    return [sum(c) for c in combinations(runs, keep)]


def near(values: np.ndarray, free: int, limit: int = CROWDED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within MAX_DISTANCE among distinct values that agree outside `free`: edges of a spanning forest, as positions."""
    if len(values) > limit and free.bit_count() > 18:
        found = []
        for mask in block_masks(free):
            part = values & np.uint64(mask)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    found += [(group[a], group[b]) for a, b in near(values[group], free & ~mask, limit)]
        return found
    left, found = np.arange(len(values)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            close = np.bitwise_count(values[left] ^ values[u]) <= MAX_DISTANCE
            if close.any():
                reached, left = left[close], left[~close]
                found.append((np.full(len(reached), u), reached))
                queue += reached.tolist()
    return found


def links_of_runs(key: np.ndarray, values: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) within runs of equal keys; key holds the number of the mask."""
    same = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(same)
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    small = np.repeat(sizes, sizes) <= 16
    for gap in range(1, 16):
        i = np.flatnonzero(small[:-gap] & (key[gap:] == key[:-gap])) if len(key) > gap else np.zeros(0, int)
        if not len(i):
            break
        i = i[np.bitwise_count(values[i] ^ values[i + gap]) <= MAX_DISTANCE]
        a.append(i)
        b.append(i + gap)
    full = (1 << BITS) - 1
    for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        for u, v in near(values[s : s + n], full & ~masks[int(key["mask"][s])]):
            a.append(u + s)
            b.append(v + s)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def links(reps: DataFrame) -> DataFrame:
    """Edges (src, dst) between the representatives of fingerprints within MAX_DISTANCE. reps: node, fp (distinct)."""
    masks = block_masks((1 << BITS) - 1)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)])
    keyed = reps.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.mask", "k.part")
    dealt = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    kind = np.dtype([("mask", np.int16), ("part", np.int64)])

    def meet(batches):
        for rows in by_key(batches, ("mask", "part", "fp", "node"), keys=2):
            yield from edges(rows)

    def edges(rows):
        mask, part, fp, node = rows
        key = np.empty(len(mask), kind)
        key["mask"], key["part"] = mask, part
        a, b = links_of_runs(key, fp.view(np.uint64), masks)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["src", "dst"])

    return dealt.mapInArrow(lean(meet), "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of `edges` (src, dst); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round's edges are written to the
    shared folder, so lost executors cost a round at most; only two sums reach the driver."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        if large:
            both = both.unionAll(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).select("u", "m")
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("m").alias("src"), F.col("v").alias("dst"))
        else:
            out = met.where("v <> m").select(F.col("m").alias("src"), F.col("v").alias("dst")).unionAll(least.select(F.col("m").alias("src"), F.col("u").alias("dst")))
        return out.where("src <> dst")

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    edges = written(edges.where("src <> dst").distinct(), "edges")
    seen = sign(edges)
    while seen[0]:
        edges = written(star(star(edges, True), False).distinct(), "edges")
        now = sign(edges)
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("dst").alias("node"), F.col("src").alias("component"))
    return pairs.unionAll(edges.select(F.col("src").alias("node"), F.col("src").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def classes(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id (smallest doc_id reachable over links) for every row of `docs`."""
    prints = written(docs.select("doc_id", fingerprint_udf(size)("text").alias("fp")), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    grouped = components(links(reps.where("node is not null")))
    named = reps.join(grouped, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_rows(docs: DataFrame, found: DataFrame, print_of) -> DataFrame:
    """`docs` with one row of each class: one with its smallest doc_id. Rows with null doc_id stay.

    found: doc_id, fp and class of every row; print_of gives fp from the text. It is decided by
    doc_id and fp together, so a repeated doc_id loses only the texts that are linked elsewhere."""
    rows = written(found.groupBy("doc_id", "fp", "class").agg(F.count("*").alias("n")), "classes")
    first = rows.groupBy("class").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    drop = rows.join(first, "class").where("doc_id <> first.doc_id or fp <> first.fp").select(F.col("doc_id").alias("__drop"), F.col("fp").alias("__fp"))
    drop = written(drop, "drop")
    if drop.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    marked = docs.withColumn("__own", print_of("text"))
    kept = marked.join(drop, (F.col("doc_id") == F.col("__drop")) & (F.col("__own") == F.col("__fp")), "left_anti")
    if rows.where("n > 1").isEmpty():
        return kept.drop("__own")
    once = kept.where("doc_id is not null").dropDuplicates(["doc_id", "__own"])
    return once.unionByName(kept.where("doc_id is null")).drop("__own")


def dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """`docs` with one row of each class of linked fingerprints, one of its smallest doc_id; a row with null doc_id stays."""
    own = docs.where("doc_id is not null")
    prints = written(own.select("doc_id", fingerprint_udf(size)("text").alias("fp")), "fingerprints")
    grouped = components(links(prints.select(F.col("fp").alias("node"), "fp").distinct())).withColumnRenamed("node", "fp")
    named = prints.join(grouped, "fp", "left").select("doc_id", "fp", F.coalesce("component", "fp").alias("class"))
    return first_rows(docs, named, fingerprint_udf(size))
