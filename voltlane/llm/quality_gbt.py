"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are those of the quality rules, as rates. Training runs on the driver over a
bounded sample of labelled rows whose statistics the executors computed; trees are
complete binary trees flattened into arrays, and scoring walks all of a block's rows
down one level at a time with numpy.

Nulls and empty texts are scored like any text (all statistics zero), very long texts are
read whole. Without both labels in the training rows every score is the share of label 1
(0.5 without rows). Repeated rows get equal scores, and so do texts whose statistics tie; a
doc_id that is repeated among the labels has its least label, and among the documents gives
one row to the sample. An empty table gives no rows. Other columns are kept; one named like
the result is replaced. Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm.common import in_training
from voltlane.llm.quality_rules import STATS, labelled, sampled, stat_columns

#: Labelled training rows, at most (lowest hashes of doc_id first).
SAMPLE_ROWS = 20_000


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    n = {k: np.asarray(stats[k], float) for k in STATS}
    words, size, letters = np.maximum(n["n_words"], 1), np.maximum(n["n_bytes"], 1), np.maximum(n["n_upper"] + n["n_lower"], 1)
    lines = np.maximum(n["n_lines"], 1)
    return np.stack([
        np.log1p(n["n_words"]), np.log1p(n["n_lines"]), n["word_chars"] / words, n["n_symbols"] / words, n["n_symbols"] / size,
        n["n_dup_lines"] / lines, n["n_repeat_words"] / words, n["n_upper"] / letters, n["n_digits"] / size, n["n_shouts"] / words,
        n["n_distinct_words"] / words, n["n_one_char"] / words, words / lines, letters / size,
    ], axis=1)


@dataclass
class Trees:
    """Complete trees of one depth: split column and cut of inner nodes, value of leaves, all flat."""

    base: float
    depth: int
    column: np.ndarray = field(repr=False)
    cut: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, cut, value in zip(self.column, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > cut[node])
            total += value[node - (len(cut))]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Newton boosting of the log loss with splits at histogram bin edges."""
    p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p))) if len(y) else 0.0
    inner = (1 << depth) - 1
    column, cut, value = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    if not len(y) or y.min() == y.max():
        return Trees(base, depth, column, cut, value)
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins)[1:-1])) for c in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], axis=1)  # x <= edge[b] for bin <= b
    raw = np.full(len(y), base)
    columns, cuts, values = [], [], []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        col, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            at = node - first
            sum_g, sum_h = np.bincount(at, g, n), np.bincount(at, h, n)
            best = np.zeros(n)
            pick = np.full(n, -1, np.int64)
            where = np.zeros(n, np.int64)
            for c, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                key = at * k + binned[:, c]
                gl, hl, nl = (np.bincount(key, w, n * k).reshape(n, k).cumsum(1)[:, :-1] for w in (g, h, None))
                total = np.bincount(at, minlength=n)[:, None]
                gain = gl**2 / (hl + ridge) + (sum_g[:, None] - gl) ** 2 / (sum_h[:, None] - hl + ridge) - (sum_g**2 / (sum_h + ridge))[:, None]
                gain[(nl < least) | (total - nl < least)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best + 1e-9
                best = np.where(better, gain[np.arange(n), top], best)
                pick, where = np.where(better, c, pick), np.where(better, top, where)
            for k in range(n):
                if pick[k] >= 0:
                    col[first + k], thr[first + k] = pick[k], edges[pick[k]][where[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), col[node]] > thr[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw = raw + v[leaf]
        columns.append(col)
        cuts.append(thr)
        values.append(v)
    return Trees(base, depth, np.array(columns), np.array(cuts), np.array(values))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `rows` labelled training documents."""
    known = labelled(labels.where(in_training(F.col("doc_id"))))
    sample = sampled(docs, known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return boost(features(sample), (sample["quality"].to_numpy() == 1).astype(float))


def classify(docs: DataFrame, labels: DataFrame, out: str = "score", trees: Trees | None = None) -> DataFrame:
    """`docs` with a double column `out`: how likely label 1 is for the whole text."""
    trees = trees or train(docs, labels)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:  # statistics and trees in one call, so that a task needs one Python worker
        return pa.array(trees.score(features(stat_columns(texts))), pa.float64())

    return docs.withColumn(out, score("text"))
