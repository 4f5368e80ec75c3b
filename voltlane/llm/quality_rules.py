"""Quality rules: text statistics, two fixed rules, and an isolation forest over the
statistics whose threshold is calibrated on labelled rows.

The forest is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, a parameter); its
threshold is set by the scores of all labelled rows, which Spark counts in SCORE_BINS bins.

Nulls and empty texts have all statistics zero and fail the base rule (fewer than 50
words). Very long texts are read whole. Repeated rows get equal verdicts; a doc_id that is
repeated among the labels has its least label, and among the documents gives one row to the
sample. Without labelled rows the forest rejects nothing and only the base rules decide; an
empty table gives no rows. Other columns are kept; one named like the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm.common import BROADCAST_IDS, SPACE, RollingHash, byte_class, give_back, mix, runs, shingle_hash, text_blocks, totals, utf8, written

SYMBOLS = byte_class(b"#*$%&|<>")
LINE = byte_class(b"\n")
UPPER = byte_class(bytes(range(65, 91)))
LOWER = byte_class(bytes(range(97, 123)))
DIGIT = byte_class(b"0123456789")
SHOUT = byte_class(b"!?")
FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # bytes that begin a code point
HIGH = np.arange(256) >= 128

#: Labelled rows that the forest is fitted on, at most (lowest hashes of doc_id first).
SAMPLE_ROWS = 20_000
#: Bins of the scores that the threshold is set by.
SCORE_BINS = 100_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_shouts", "n_distinct_words", "n_bytes", "n_one_char")
STAT_TYPE = pa.struct([(s, pa.int64()) for s in STATS])
STAT_SCHEMA = T.StructType([T.StructField(s, T.LongType()) for s in STATS])


def block_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of one block (no nulls)."""
    buf, offsets = utf8(texts)
    words = ~SPACE[buf]
    starts, ends = runs(words, offsets)
    of_doc = np.searchsorted(starts, offsets)
    n_words = np.diff(of_doc)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)
    salt = mix(doc + np.uint64(1))
    hashes = RollingHash(buf)
    h = hashes.of(starts, ends)

    # 3-word windows found twice or more within a text; the words that they cover
    window = shingle_hash(h, 3)
    inside = doc[2:] == doc[:-2] if len(doc) > 2 else np.zeros(0, bool)
    where = np.flatnonzero(inside)
    covered = np.zeros(len(h) + 2, bool)
    if len(where):
        _, inverse, counts = np.unique(window[where] ^ salt[where], return_inverse=True, return_counts=True)
        again = where[counts[inverse] > 1]
        for k in range(3):
            covered[again + k] = True

    # lines: from a text's start or after \n, to \n or the text's end
    feed = np.flatnonzero(LINE[buf])
    line_starts = np.sort(np.concatenate([offsets[:-1], feed + 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], feed]))
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(words, out=seen[1:])
    full = seen[line_ends] > seen[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    n_lines = np.bincount(line_doc, minlength=len(texts))
    line_key = hashes.of(line_starts, line_ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line_key, return_index=True)
    distinct_lines = np.bincount(line_doc[first], minlength=len(texts))
    _, first = np.unique(h ^ salt, return_index=True)

    at = lambda table: totals(table[buf], offsets)
    return {
        "n_words": n_words,
        "word_chars": totals(FIRST[buf] & words, offsets),
        "n_symbols": at(SYMBOLS),
        "n_dup_lines": n_lines - distinct_lines,
        "n_repeat_words": totals(covered[: len(h)], of_doc),
        "n_lines": n_lines,
        "n_upper": at(UPPER),
        "n_lower": at(LOWER | HIGH),
        "n_digits": at(DIGIT),
        "n_shouts": at(SHOUT),
        "n_distinct_words": np.bincount(doc[first].astype(np.int64), minlength=len(texts)),
        "n_bytes": np.diff(offsets),
        "n_one_char": totals((ends - starts) == 1, of_doc),
    }


def stat_columns(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [block_stats(b) for b in text_blocks(texts)]
    return {s: np.concatenate([p[s] for p in parts]) if parts else np.zeros(0, np.int64) for s in STATS}


@F.arrow_udf(STAT_SCHEMA)
def text_stats(texts: pa.Array) -> pa.Array:
    columns = stat_columns(texts)
    return pa.StructArray.from_arrays([pa.array(columns[s], pa.int64()) for s in STATS], fields=list(STAT_TYPE))


def features(s: pd.DataFrame | dict) -> np.ndarray:
    """Scale-free rule statistics, one row per text.

    Repeated lines and words, word length and digits are left out: splits on them dilute the
    others (fitted on half of sf0.1's labels, the forest rejects 79 of the other half's 150
    bad rows that pass the fixed rules with them, and 150 without)."""
    n = {k: np.asarray(s[k], float) for k in STATS}
    words, letters = np.maximum(n["n_words"], 1), np.maximum(n["n_upper"] + n["n_lower"], 1)
    return np.stack([
        np.log1p(n["n_symbols"] / words),
        n["n_upper"] / letters,
        n["n_shouts"] / words,
        n["n_one_char"] / words,
    ], axis=1)


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random axis-parallel splits; few splits isolate an anomaly. Trees are flat arrays."""

    def __init__(self, trees: int = 100, sample: int = 128, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        depth = int(np.ceil(np.log2(max(self.sample, 2)))) + 2
        size = (1 << (depth + 1)) - 1
        self.depth = depth
        self.column = np.full((self.trees, size), -1, np.int16)
        self.cut = np.zeros((self.trees, size))
        self.length = np.zeros((self.trees, size))
        for t in range(self.trees):
            rows = x[rng.choice(len(x), min(self.sample, len(x)), replace=False)]
            stack = [(0, 0, rows)]
            while stack:
                node, level, part = stack.pop()
                low, high = part.min(0), part.max(0)
                free = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(free):
                    self.length[t, node] = level + path_norm(len(part))
                    continue
                c = int(rng.choice(free))
                cut = rng.uniform(low[c], high[c])
                left = part[:, c] < cut
                if not left.any() or left.all():
                    self.length[t, node] = level + path_norm(len(part))
                    continue
                self.column[t, node], self.cut[t, node] = c, cut
                stack += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        self.norm = float(path_norm(min(self.sample, len(x)))) or 1.0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher: isolated sooner."""
        total, every = np.zeros(len(x)), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                c = self.column[t, node]
                go = c >= 0
                if not go.any():
                    break
                step = 2 * node + 1 + (x[every, np.maximum(c, 0)] >= self.cut[t, node])
                node = np.where(go, step, node)
            total += self.length[t, node]
        return np.exp2(-total / self.trees / self.norm)


def calibrate(scores: np.ndarray, bad: np.ndarray, max_clean_loss: float, weight: np.ndarray | None = None) -> float:
    """The threshold that catches most bad rows while at most that share of good rows is at or above it."""
    weight = np.ones(len(scores)) if weight is None else weight
    if not len(scores) or not bad.any() or bad.all():
        return np.inf
    order, at = np.unique(scores, return_inverse=True)
    above = lambda rows: np.bincount(at[rows], weight[rows], len(order))[::-1].cumsum()[::-1] / weight[rows].sum()
    lost, caught = above(~bad), above(bad)
    fine = np.flatnonzero((lost <= max_clean_loss) & (caught > 0))
    if not len(fine):
        return np.inf
    best = fine[np.argmax(caught[fine] - lost[fine])]
    below = scores[~bad & (scores < order[best])]
    return float((order[best] + below.max()) / 2) if len(below) else float(order[best])


def sampled(docs: DataFrame, picked: DataFrame) -> pd.DataFrame:
    """Label and statistics of the documents in `picked` (doc_id, quality; bounded), one row of each doc_id."""
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return found.select("doc_id", "quality", text_stats("text").alias("s")).select("doc_id", "quality", "s.*").toPandas().sort_values("doc_id")


def labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def judged(forest: IsolationForest | None):
    """The statistics of each text and the forest's score in one call, so that a task needs one Python worker."""

    @F.arrow_udf(T.StructType([*STAT_SCHEMA, T.StructField("anomaly", T.DoubleType())]))
    def seen(texts: pa.Array) -> pa.Array:
        columns = stat_columns(texts)
        score = forest.score(features(columns)) if forest and len(texts) else np.zeros(len(texts))
        give_back()
        return pa.StructArray.from_arrays([*(pa.array(columns[s], pa.int64()) for s in STATS), pa.array(score, pa.float64())], names=[*STATS, "anomaly"])

    return seen.asNondeterministic()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_clean_loss: float = 0.002) -> tuple[IsolationForest | None, float]:
    """The forest, from at most `rows` labelled documents, and its threshold, from all of them."""
    known = written(labelled(labels), "labelled")
    sample = sampled(docs, known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    if not len(sample):
        return None, np.inf
    forest = IsolationForest().fit(features(sample))
    # one rule for any number of labels: scores of one row of each labelled doc_id, counted in bins
    few = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text")
    texts = texts.join(F.broadcast(known), "doc_id") if few else texts  # else light rows of statistics are joined, not texts
    seen = texts.select(*[c for c in texts.columns if c != "text"], F.struct(F.xxhash64("text"), F.length("text")).alias("which"), judged(forest)("text").alias("s"))
    seen = seen if few else seen.join(known, "doc_id")
    once = seen.groupBy("doc_id", "quality").agg(F.min_by(F.struct(rule(F.col("s")).alias("failed"), F.col("s.anomaly").alias("score")), "which").alias("m")).where("not m.failed")
    bins = once.groupBy(F.floor(F.col("m.score") * SCORE_BINS).alias("bin"), (F.col("quality") == 0).alias("bad")).count().toPandas()
    return forest, calibrate((bins["bin"].to_numpy(float) + 0.5) / SCORE_BINS, bins["bad"].to_numpy(bool), max_clean_loss, bins["count"].to_numpy(float))


def rule(s):
    """The fixed rules as a column, from a struct of statistics."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def base_failed(s):
    """The fixed rules, on a data frame of statistics or on columns."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def assess(docs: DataFrame, labels: DataFrame, out: str = "quality") -> DataFrame:
    """`docs` with a struct column `out`: the statistics, base_failed, the forest's score and kept."""
    forest, threshold = fit(docs, labels)
    s = docs.withColumn(out, judged(forest)("text"))
    failed = rule(F.col(out))
    return s.withColumn(out, F.col(out).withField("base_failed", failed).withField("kept", ~failed & (F.col(f"{out}.anomaly") < F.lit(float(threshold)))))
