"""Benchmark decontamination with spaced seeds.

A spaced seed is a mask over a span of successive words; hashed are the words at its ones,
so a substituted word under a zero does not matter. The masks' hashes of the benchmark
are a sorted array, those of the documents are looked up in it at every position, and
each hit's diagonal of document and item is compared word by word. An overlap counts if it
begins and ends on equal words and has at least `min_words` aligned words (the whole item,
if that is shorter) of which at least `min_share` are equal.

No overlap of 12 words and 80 % is without a hit: with e words substituted, at least 4e
(10 if e is 2) equal ones fall into e + 1 runs, so one run has four words, unless 15 words
are four runs of three, which the second mask is. Items of fewer words than that are looked
up by the run that their own length leaves.

Items of fewer than MIN_ITEM words (a parameter) are no evidence, wherever they occur, and match nothing.

Words are runs of letters and digits, lower-cased. The benchmark goes to the executors in chunks of at
most CHUNK_WORDS words; a larger benchmark takes several passes over the documents, so
what is broadcast stays bounded. Null and empty texts and items match nothing; repeated
rows match alike; very long texts are compared whole. An empty table or benchmark gives an
empty result. Other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import RollingHash, byte_class, mix, runs, text_blocks, utf8, without

#: Ones are hashed, zeros are ignored.
SEEDS = ("1111", "111011101110111")
MIN_WORDS, MIN_SHARE = 12, 0.8
#: Items with fewer words match nothing, unless `find_overlaps` is told otherwise (min_item).
MIN_ITEM = 5
#: Words of benchmark items that one pass broadcasts, at most (one longer item is a chunk of its own).
CHUNK_WORDS = 2_000_000
#: Hits that are compared at a time, about.
HITS = 500_000

WORD = byte_class(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a block, and where each text's words begin."""
    lower = pa.array([t.lower() for t in texts.to_pylist()], pa.string())
    buf, offsets = utf8(lower)
    starts, ends = runs(WORD[buf], offsets)
    return RollingHash(buf).of(starts, ends), np.searchsorted(starts, offsets)


def spaced(h: np.ndarray, seed: str, salt: int) -> np.ndarray:
    """The seed's hash at each position where it fits."""
    n = len(h) - len(seed) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, bit in enumerate(seed):
        if bit == "1":
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def least_equal(n: int, share: float) -> int:
    """How many of n words must be equal."""
    return math.ceil(n * share - 1e-9)


def least_run(n: int, share: float) -> int:
    """The longest run of equal words is at least this long if enough of n words are equal."""
    wrong = n - least_equal(n, share)
    return -(-(n - wrong) // (wrong + 1))


def longest(same: np.ndarray, least: int, share: float) -> tuple[int, int]:
    """The longest stretch of at least `least` words that begins and ends on True and is True in `share` of its words; (0, 0) if none."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    score = np.arange(len(at)) - share * at  # a stretch from at[i] to at[j] is good if its gain is 0 or more
    bound = np.minimum.accumulate(score)
    i = np.searchsorted(-bound, -(score + 1 - share) - 1e-9)  # the first start that is low enough
    size = at - at[i] + 1
    j = int(np.argmax(size))
    return (int(at[i[j]]), int(at[j]) + 1) if size[j] >= least else (0, 0)


class BenchmarkIndex:
    """Sorted seed hashes of one chunk of items, with the place in the items that each stands for."""

    def __init__(self, item_ids: list[int], texts: list[str], seeds: tuple[str, ...] = SEEDS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, min_item: int = MIN_ITEM):
        self.ids = np.array(item_ids, np.int64)
        self.min_words, self.min_share = min_words, min_share
        blocks = [words_of(b) for b in text_blocks(pa.array(texts, pa.string()))]
        self.words = np.concatenate([w for w, _ in blocks]) if blocks else np.zeros(0, np.uint64)
        sizes = np.concatenate([np.diff(o) for _, o in blocks]) if blocks else np.zeros(0, int)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        item = np.repeat(np.arange(len(sizes)), sizes)
        self.sizes = sizes
        self.short = [0] * len(seeds) + sorted({int(n) for n in sizes if max(min_item, 1) <= n < min_words})
        self.seeds = [*seeds, *("1" * least_run(n, min_share) for n in self.short[len(seeds) :])]
        self.tables = []
        for k, seed in enumerate(self.seeds):
            h = spaced(self.words, seed, k + 1)
            at = np.arange(len(h))
            within = item[at] == item[at + len(seed) - 1] if len(at) else np.zeros(0, bool)
            within &= sizes[item[at]] == self.short[k] if self.short[k] else sizes[item[at]] >= min_words
            h, at = h[within], at[within]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((h[order], at[order], bits))

    def overlaps(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item position, start and end word in the text, equal words), longest per text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = [x for k in range(len(self.seeds)) for x in self._diagonals(k, words, first, doc)]
        if not found:
            return []
        for d, item, shift in np.unique(np.concatenate(found), axis=0).tolist():
            start, end, equal = self._stretch(words, first, d, item, shift)
            if end > start and ((d, item) not in best or equal > best[d, item][2]):
                best[d, item] = (start - int(first[d]), end - int(first[d]), equal)
        return [(d, item, *v) for (d, item), v in best.items()]

    def _diagonals(self, k, words, first, doc):
        """Rows (text, item, position in the text less position in the items) of the hits of one seed that may be overlaps."""
        (known, places, bits), seed = self.tables[k], self.seeds[k]
        h = spaced(words, seed, k + 1)
        if not len(known) or not len(h):
            return
        at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
        at = at[doc[at] == doc[at + len(seed) - 1]]
        low = np.searchsorted(known, h[at], side="left")
        n = np.searchsorted(known, h[at], side="right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        ends = np.cumsum(n)
        begin = 0
        while begin < len(at):
            upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin] - n[begin]) + HITS, side="right")))
            m = n[begin:upto]
            hit = np.repeat(at[begin:upto], m)
            place = places[np.repeat(low[begin:upto], m) + np.arange(len(hit)) - np.repeat(np.cumsum(m) - m, m)]
            item = np.searchsorted(self.first, place, side="right") - 1
            good = self._promising(k, words, first, doc[hit], item, hit, place)
            yield np.stack([doc[hit], item, hit - place], axis=1)[good]
            begin = upto

    def _promising(self, k, words, first, d, item, at, place):
        """False for hits that are in no overlap; the shortest overlaps, of fewer than 2 * min_words, are in all others."""
        if self.short[k]:
            low, span = self.first[item] - place, self.short[k]
            need, tries = least_equal(span, self.min_share), 1
        else:
            span = self.min_words
            tries = span - len(self.seeds[k]) + 1
            if tries < 1:
                return np.ones(len(at), bool)
            low = np.full(len(at), 1 - tries)
            most = 2 * span - 1
            need = span - (most - least_equal(most, self.min_share))
        inside = np.zeros((tries + span - 1, len(at)), np.int16)
        same = np.zeros((tries + span - 1, len(at)), np.int16)
        for j in range(len(inside)):
            x, y = at + low + j, place + low + j
            ok = (x >= first[d]) & (x < first[d + 1]) & (y >= self.first[item]) & (y < self.first[item + 1])
            inside[j] = ok
            same[j] = ok & (words[np.where(ok, x, 0)] == self.words[np.where(ok, y, 0)])
        good = np.zeros(len(at), bool)
        for j in range(tries):
            good |= (inside[j : j + span].sum(0) == span) & (same[j : j + span].sum(0) >= need)
        return good

    def _stretch(self, words, first, d, item, shift):
        """The longest overlap on a diagonal: begins and ends on equal words, long enough, enough of them equal."""
        a = max(int(first[d]), int(self.first[item]) + shift)
        b = min(int(first[d + 1]), int(self.first[item + 1]) + shift)
        start, end = longest(words[a:b] == self.words[a - shift : b - shift], min(self.min_words, int(self.sizes[item])), self.min_share)
        return a + start, a + end, int((words[a + start : a + end] == self.words[a + start - shift : a + end - shift]).sum())


SCHEMA = "doc_id long, item_id long, start_word long, end_word long, equal_words long"


def chunks(benchmark: DataFrame, limit: int = CHUNK_WORDS):
    """Lists of (item_id, text), each of at most `limit` words; read one chunk at a time."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id", "text").agg(F.size(F.split("text", r"\s+")).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    if total <= limit:
        yield [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]
        return
    parts = -(-2 * total // limit)
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for k in range(parts):
        chunk = []
        size = 0
        for r in dealt.where(F.col("part") == k).orderBy("item_id", "text").toLocalIterator():
            if chunk and size + r["n"] > limit:
                yield chunk
                chunk, size = [], 0
            chunk.append((r["item_id"], r["text"]))
            size += r["n"]
        if chunk:
            yield chunk


def find_overlaps(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id and the longest overlap of each pair of document and item that share one."""
    spark, found = docs.sparkSession, None
    for chunk in chunks(benchmark):
        index = spark.sparkContext.broadcast(BenchmarkIndex([i for i, _ in chunk], [t for _, t in chunk], **options))

        def scan(batches, index=index):
            own = index.value
            for batch in batches:
                ids, at = batch.column("doc_id"), 0
                for block in text_blocks(batch.column("text")):
                    rows = own.overlaps(*words_of(block))
                    if rows:
                        d, item, start, end, equal = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + d)), *map(pa.array, (own.ids[item], start, end, equal))], names=["doc_id", "item_id", "start_word", "end_word", "equal_words"])
                    at += len(block)

        part = docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("equal_words"), "start_word", "end_word")
    return found.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that share a passage with the benchmark; null doc_ids stay."""
    return without(docs, find_overlaps(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
