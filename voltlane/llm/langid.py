"""Language identification with n-gram filters that answer for all languages at once.

Every slot of the Bloom filter holds one bit per language (a bit-sliced filter), so k
look-ups and two ANDs give the set of all languages that contain an n-gram. Per text,
the set bits are counted per language, corrected for the share of false positives that
each language's fill gives, and the largest corrected count wins.

N-grams are four successive bytes of the lower-cased text between spaces, and none reaches
into a neighbouring text, so an answer depends on the text alone, whatever stands before or
after it. Any number of languages is learned: a slot is one or more words of bits.

The filter is fitted on a bounded sample of labelled rows: about DOCS_PER_LANG documents of
each language (a parameter). Of these it learns every n-gram, however rare, that is at least
half as frequent in the language as where it is most frequent, so a language with a single
short text is learned too; the filter grows with what it holds.

Null texts and texts without a letter get `und` and score 0. Texts with letters but no
known n-gram get the first learned language by name with score 0. Without training rows
every text gets `und`, an empty table gives no rows, and very long texts are read whole.
Repeated rows get equal answers; ties go to the first language by name. Other columns are
kept; one named like the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm.common import in_training, small, text_blocks, totals

#: Training documents for each language, about: those whose hash is below the share that this makes of the language's rows.
DOCS_PER_LANG = 3_000
GRAM = 4
#: Bits of one word of a slot.
WORD = 64


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts between spaces, as one buffer and where each begins; all have an n-gram of their own."""
    parts = [b" " + t.lower().encode() + b"   " for t in texts.to_pylist()]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def grams(buf: np.ndarray) -> np.ndarray:
    """The 4-byte n-gram that begins at each byte, but for the last three."""
    x = buf.astype(np.uint32)
    n = max(0, len(x) - GRAM + 1)
    return x[:n] | x[1 : n + 1] << np.uint32(8) | x[2 : n + 2] << np.uint32(16) | x[3 : n + 3] << np.uint32(24)


def own_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that lie within one text each, in order, and where each text's begin (one more at the end)."""
    buf, offsets = padded(texts)
    last = np.zeros(len(buf) + 1, bool)
    for k in range(1, GRAM):
        last[offsets[1:] - k] = True
    g = grams(buf)
    return g[~last[: len(g)]], offsets - (GRAM - 1) * np.arange(len(offsets))


@dataclass
class LanguageFilter:
    """A bit-sliced Bloom filter: word L // 64 of `slots[:, h]` has bit L % 64 set if language L has an n-gram with hash h."""

    langs: list[str]
    slots: np.ndarray
    hashes: int
    false_share: np.ndarray

    @staticmethod
    def build(langs: list[str], grams_of: list[np.ndarray], bits: int = 20, hashes: int = 3) -> LanguageFilter:
        # a language fills an eighth of its slots at most
        bits = max(bits, int(8 * hashes * max(map(len, grams_of), default=0)).bit_length())
        width = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(w).itemsize * 8 >= min(len(langs), WORD))
        slots = np.zeros((-(-len(langs) // WORD), 1 << bits), width)
        fill = np.zeros(len(langs))
        for k, g in enumerate(grams_of):
            row, bit = slots[k // WORD], width(1 << k % WORD)
            for at in positions(g.astype(np.uint32), bits, hashes):
                np.bitwise_or.at(row, at, bit)
            fill[k] = ((row & bit) != 0).mean()
        return LanguageFilter(langs, slots, hashes, fill**hashes)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """The set of languages that contain each n-gram, as bits: one row for each word of a slot."""
        out = None
        for at in positions(g, self.slots.shape[1].bit_length() - 1, self.hashes):
            found = self.slots[:, at]
            out = found if out is None else out & found
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Corrected counts of known n-grams, one row per text and one column per language."""
        g, begin = own_grams(texts)
        masks = self.masks(g)
        n = np.maximum(np.diff(begin), 1)
        out = np.empty((len(texts), len(self.langs)))
        for k, false in enumerate(self.false_share):
            seen = totals((masks[k // WORD] & masks.dtype.type(1 << k % WORD)) != 0, begin)
            out[:, k] = np.maximum((seen - n * false) / (1 - false), 0) if false < 1 else 0
        return out


def positions(g: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    a = g * np.uint32(0x9E3779B1)
    b = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA77) | np.uint32(1)
    return [(a + np.uint32(k) * b) >> np.uint32(32 - bits) for k in range(hashes)]


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> LanguageFilter | None:
    """The filter, from text and lang of a bounded sample of the training documents."""
    known = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    # the share of its rows that each language gives; equal texts of a language count once
    shares = small(known.groupBy("lang").count().select(F.col("lang").alias("__lang"), (F.lit(float(docs_per_lang)) / F.col("count")).alias("share")), "languages")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(shares, F.col("lang") == F.col("__lang")).where(place < F.col("share")).select("text", "lang").dropDuplicates(["text", "lang"])

    def count(batches):
        for batch in batches:
            tags = np.array(batch.column("lang").to_pylist(), object)
            for tag in sorted(set(tags)):
                found: dict[int, int] = {}
                for block in text_blocks(batch.column("text").filter(pa.array(tags == tag))):
                    g, n = np.unique(own_grams(block)[0], return_counts=True)
                    for a, b in zip(g.tolist(), n.tolist(), strict=True):
                        found[a] = found.get(a, 0) + b
                yield pa.RecordBatch.from_arrays([pa.array([tag] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language has an n-gram if it is about as frequent there as where it is most frequent
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counted.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total"))
    own = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= 0.5 * F.col("most"))
    rows = own.select("lang", "gram").toPandas()
    if not len(rows):
        return None
    names = sorted(rows["lang"].unique())
    return LanguageFilter.build(names, [np.sort(rows.loc[rows["lang"] == x, "gram"].to_numpy()) for x in names])


def identify(docs: DataFrame, out: str = "language", model: LanguageFilter | None = None) -> DataFrame:
    """`docs` with a struct column `out` of lang_pred and score, from whole texts alone."""
    model = model or train(docs)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for block in text_blocks(texts):
            if model is None:
                names += ["und"] * len(block)
                scores += [0.0] * len(block)
                continue
            counts = model.counts(block)
            best, total = counts.argmax(1), counts.sum(1)
            share = np.where(total > 0, counts[np.arange(len(block)), best] / np.maximum(total, 1e-9), 0.0)
            for k, text in enumerate(block.to_pylist()):
                has = lettered(text)
                names.append(model.langs[best[k]] if has else "und")
                scores.append(float(share[k]) if has else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(out, predict("text"))
