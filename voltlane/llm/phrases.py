"""Phrase collocation mining after Toivonen: a sample proposes, whole passes count exactly.

Texts are lower-cased (A-Z), cut into pieces at `. , ; : ! ?` and line ends, and pieces into
words at spaces and tabs. Phrases are runs of words within a piece; all counts are by language.

1. A share of the documents proposes the words and phrases that it holds SAMPLE_MIN times.
2. A pass over all texts counts every word, every proposed phrase and the negative border:
   phrases that are not proposed although the two phrases of one word less within them are.
   So a phrase of n words is counted if both its parts of n - 1 words are proposed.
3. Words and phrases of the border that turn out frequent are failures of the sample: they
   are proposed too, and a further pass counts what becomes possible by them and was not
   counted yet, until no failure is left. Then no frequent phrase can be missing, however
   bad the sample was.

What is proposed goes to the tasks as a Bloom filter of fixed size (BLOOM_BITS). Its false
positives have more phrases counted, never fewer, and each filter holds all of the one before,
so what a pass counted is known from the filters alone. Tasks count phrases of blocks of
texts by integer keys and hand on a row for each phrase; Spark sums these.

Score of a cut of a phrase: floor(1000000 * a * a / (l * r)), in decimals of 38 digits, which
hold counts up to 10^15; of a phrase's cuts the lowest counts, then the first. Phrases that
lie within a longer candidate at least half as frequent go.

Null texts are empty, a null language is `und`; a very long text is counted window by window;
repeated rows count as often as they stand there; ties go by count and phrase (as UTF-8);
an empty table gives no rows. Only text, lang and doc_id (if there, for the sample) are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import mix, written

#: One document of so many is in the sample, and how often it must hold what it proposes.
SAMPLE_OF, SAMPLE_MIN = 8, 2
#: Bits of the filter of proposals (16 MB) and bits set for each.
BLOOM_BITS, BLOOM_HASHES = 1 << 27, 3
#: Bytes of text that a task cuts into words at once, and words whose phrases it counts at once.
CHUNK, WINDOW = 4 << 20, 1 << 18
#: Different phrases that a task holds before it hands them on.
HELD = 4_000_000
#: Marks and line ends that end a piece become dots, tabs spaces.
PIECES = bytes(46 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))
FOLD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, size int, phrase string, n long, known boolean"


class _Words(dict):
    """Numbers of words, from 1 on in order of first appearance; the dot, which ends pieces, is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases, from those of their words but the last, and of the last."""
    return mix(h * FOLD + word)


def bit_places(h: np.ndarray, bits: int = BLOOM_BITS) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [(h + np.uint64(k) * step) % np.uint64(bits) for k in range(BLOOM_HASHES)]


def holds(bloom: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds; without a filter, none."""
    if bloom is None:
        return np.zeros(len(h), bool)
    found = np.ones(len(h), bool)
    for at in bit_places(h, len(bloom) * 64):
        found &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


class Tally:
    """Counts of the words and phrases of one language in a task: what the filter `now` allows and `before` did not; `everything`: all.

    A phrase is the numbers of its words, packed into one integer."""

    def __init__(self, lang: str, most: int, now: np.ndarray | None, before: np.ndarray | None, everything: bool):
        self.lang, self.most, self.now, self.before, self.everything = lang, most, now, before, everything
        self.bits = np.int64(63 // most)
        self.clear()

    def clear(self) -> None:
        self.number = _Words({b".": 0})
        self.hashes, self.allowed, self.fresh = np.zeros(1, np.uint64), np.zeros(1, bool), np.zeros(1, bool)
        self.words = np.zeros(1, np.int64)
        self.phrases: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {size: [] for size in range(2, self.most + 1)}
        self.held = 0

    def full(self, window: int) -> bool:
        return len(self.number) + window + self.most >= 1 << self.bits or self.held >= HELD

    def learn(self, ids: np.ndarray) -> None:
        """Hashes of the words that are new, and which of them the filters hold."""
        old, words = len(self.hashes), list(self.number)
        if len(words) > old:
            h = word_hashes(words[old:], self.lang)
            self.hashes = np.concatenate([self.hashes, h])
            self.allowed = np.concatenate([self.allowed, holds(self.now, h) | self.everything])
            self.fresh = np.concatenate([self.fresh, ~holds(self.before, h)])
            self.words = np.concatenate([self.words, np.zeros(len(h), np.int64)])
        self.words += np.bincount(ids, minlength=len(words))

    def add(self, tokens: list[bytes], window: int) -> None:
        """Counts what begins within the first `window` tokens; those after only end phrases."""
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        self.learn(ids[:window])
        if self.most < 2:
            return
        # of each phrase of the length before: its packed words, its hash, whether it is allowed and whether it was not before
        packed, gram, allowed, fresh = np.arange(len(self.hashes)), self.hashes, self.allowed, self.fresh
        if len(packed) < len(self.number):  # words that only end phrases here
            self.learn(ids[:0])
            packed, gram, allowed, fresh = np.arange(len(self.hashes)), self.hashes, self.allowed, self.fresh
        at = ids  # which of them begins at a word
        for size in range(2, self.most + 1):
            fine = np.where(at >= 0, allowed[at], False)
            where = np.flatnonzero(fine[:-1] & fine[1:])
            if not len(where):
                return
            unique, first, which = np.unique(packed[at[where]] << self.bits | ids[where + size - 1], return_index=True, return_inverse=True)
            head, tail, last = at[where[first]], at[where[first] + 1], ids[where[first] + size - 1]
            n = np.bincount(which[where < window], minlength=len(unique))
            new = (fresh[head] | fresh[tail]) & (n > 0)  # else both parts were allowed before, and the phrase was counted then
            self.phrases[size].append((unique[new], n[new]))
            self.held += int(new.sum())
            packed, gram = unique, longer(gram[head], self.hashes[last])
            allowed, fresh = holds(self.now, gram) | self.everything, ~holds(self.before, gram)
            at = np.full(len(at) - 1, -1, np.int64)
            at[where] = which

    def merge(self) -> None:
        """Puts the counts of equal phrases together."""
        self.held = 0
        for size, parts in self.phrases.items():
            if parts:
                keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                begin = np.flatnonzero(np.diff(keys, prepend=-1))
                self.phrases[size] = [(keys[begin], np.add.reduceat(n, begin) if len(begin) else n)]
                self.held += len(begin)

    def rows(self, at_once: int = 500_000) -> Iterator[pa.RecordBatch]:
        """COUNTS of all that is held; then nothing is."""
        names = pa.array(list(self.number), pa.binary()).cast(pa.string())

        def batch(size: int, phrases: pa.Array, n: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
            k = len(n)
            return pa.RecordBatch.from_arrays([pa.array([self.lang] * k, pa.string()), pa.array(np.full(k, size, np.int32)), phrases, pa.array(n), pa.array(known)], names=["lang", "size", "phrase", "n", "known"])

        if self.before is None and len(names) > 1:
            yield batch(0, pa.array([""]), self.words[1:].sum(keepdims=True), np.ones(1, bool))
            some = np.flatnonzero(self.words[1:]) + 1
            yield batch(1, names.take(pa.array(some)), self.words[some], self.allowed[some])
        self.merge()
        for size, parts in self.phrases.items():
            for keys, counts in parts:
                for k in range(0, len(keys), at_once):
                    key, n = keys[k : k + at_once], counts[k : k + at_once]
                    ids = [key >> self.bits * np.int64(size - 1 - j) & ((np.int64(1) << self.bits) - 1) for j in range(size)]
                    spelled = pc.binary_join_element_wise(*[names.take(pa.array(i)) for i in ids], " ")
                    known = holds(self.now, reduce(longer, (self.hashes[i] for i in ids))) | self.everything
                    yield batch(size, spelled, n, known)
        self.clear()


def counted(docs: DataFrame, most: int, now=None, before=None, everything: bool = False, chunk: int = CHUNK, window: int = WINDOW) -> DataFrame:
    """COUNTS over all texts, summed.

    A task hands on each of its phrases once, so they are dealt out as they are: another sum before would find nothing to add."""

    def count(batches):
        texts: dict[str, list[str]] = defaultdict(list)
        allowed, earlier = now and now.value, before and before.value
        tallies: dict[str, Tally] = {}
        size = 0

        def take() -> Iterator[pa.RecordBatch]:
            for lang in list(texts):
                joined = b".".join(t.encode() for t in texts.pop(lang)).lower().translate(PIECES)
                tokens = joined.replace(b".", b" . ").split()
                tally = tallies.setdefault(lang, Tally(lang, most, allowed, earlier, everything))
                for k in range(0, len(tokens), window):
                    if tally.full(window):
                        tally.merge()
                        if tally.held >= HELD // 2 or tally.full(window):
                            yield from tally.rows()
                    tally.add(tokens[k : k + window + most - 1], window)
            if sum(t.held + len(t.number) for t in tallies.values()) >= HELD:
                for t in tallies.values():
                    t.merge()
                if sum(t.held + len(t.number) for t in tallies.values()) >= HELD // 2:
                    for t in tallies.values():
                        yield from t.rows()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                texts[lang].append(text)
                size += len(text)
                if size >= chunk:
                    yield from take()
                    size = 0
        yield from take()
        for t in tallies.values():
            yield from t.rows()

    keys = ["lang", "size", "phrase"]
    return docs.mapInArrow(count, COUNTS).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.first("known").alias("known"))


def bloom_of(rows: DataFrame, bloom: np.ndarray | None, bits: int = BLOOM_BITS) -> np.ndarray:
    """The filter `bloom` (None: empty) with the phrases of `rows` (lang, phrase) added; at most bits / 64 rows come to the driver."""

    def places(batches):
        for batch in batches:
            found: list[np.ndarray] = []
            langs = np.array(batch.column("lang").to_pylist(), object)
            phrases = batch.column("phrase").to_pylist()
            for lang in set(langs):
                mine = [phrases[k].encode().split(b" ") for k in np.flatnonzero(langs == lang)]
                number = _Words()
                ids = [[number[w] for w in p] for p in mine]
                hashes = word_hashes(list(number), lang)
                for size in set(map(len, ids)):
                    of = np.array([p for p in ids if len(p) == size])
                    found += bit_places(reduce(longer, (hashes[of[:, k]] for k in range(size))), bits)
            if found:
                at = np.unique(np.concatenate(found))
                slot, begin = np.unique(at >> np.uint64(6), return_index=True)
                masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(masks.view(np.int64))], names=["slot", "mask"])

    merged = rows.select("lang", "phrase").mapInArrow(places, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64) if bloom is None else bloom.copy()
    out[merged.column("slot").to_numpy()] |= merged.column("mask").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = 10, most: int = 3, sample_of: int = SAMPLE_OF, sample_min: int = SAMPLE_MIN, bits: int = BLOOM_BITS, **sizes) -> tuple[DataFrame, int]:
    """lang, size, phrase, n of all phrases of up to `most` words that occur `least` times in their language, exactly, and the passes made.

    Size 0 (phrase '') is the number of words of the language, whatever its size; `sizes`: chunk and window of a task."""
    spark = docs.sparkSession
    place = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), place.alias("__place"))
    whole = texts.select("text", "lang")
    proposed = counted(texts.where(F.pmod("__place", F.lit(sample_of)) == 0).select("text", "lang"), most - 1, everything=True, **sizes).where((F.col("n") >= sample_min) & (F.col("size") > 0))
    now, before, found = bloom_of(proposed, None, bits), None, []
    while True:
        shared = [None if b is None else spark.sparkContext.broadcast(b) for b in (now, before)]
        rows = written(counted(whole, most, *shared, **sizes).where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")
        found.append(rows)
        failures = rows.where(~F.col("known") & (F.col("size") < most))
        for b in filter(None, shared):
            b.unpersist()
        if failures.isEmpty():
            return reduce(DataFrame.unionByName, found).drop("known"), len(found)
        before, now = now, bloom_of(failures, now, bits)


def part(words: Column, begin: int | Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def first_of(rows: DataFrame, group: str, order: list[Column], top: int, rank: str) -> DataFrame:
    """The first `top` rows of each group with their rank; rounds over fewer and fewer parts of a group, so no task sorts a whole one."""
    for parts in (256, 16, 1):
        rows = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))).where(F.col(rank) <= top)
    return rows.drop("__part")


def collocations(docs: DataFrame, least: int = 10, most: int = 3, top: int = 2000, within: int = 50, **sampling) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of 2 to `most` words of each language.

    A phrase goes if `within` hundredths of its occurrences, at least, could be those of one longer candidate around it."""
    counts, _ = frequent_phrases(docs, least, most, **sampling)
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("words"))
    # phrases of two words and more that lie within longer ones
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part(F.col("words"), i, n))))
    held = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("__longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("__longer") < within * F.col("a"), F.lit(True)))
    cut = lambda k: F.struct(k.alias("k"), part(F.col("words"), 1, k).alias("first"), part(F.col("words"), k + 1, F.col("size") - k).alias("rest"))
    cuts = kept.withColumn("cut", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))).select("lang", "phrase", "a", "cut.*")
    parts = counts.where((F.col("size") > 0) & (F.col("size") < most))
    of = lambda name, n: parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    scored = both.withColumn("score", F.expr("cast(a as decimal(15)) * cast(a as decimal(15)) * cast(1000000 as decimal(7)) div (cast(l as decimal(15)) * cast(r as decimal(15)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    ranked = first_of(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    # as many rows as there are languages in some blocks: the sums of words are joined last, to at most `top` rows of each
    n = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
