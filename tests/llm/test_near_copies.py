import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from voltlane.llm import near_copies, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOC)


def brute_firsts(texts):
    """The smallest id of each class of texts at 0.8 or more of their five-word shingles, by comparing all pairs."""
    sets = {d: frozenset(simhash.shingles((t or "").encode(), 5)) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d for d in ids if find(d) == d}


def test_stage_links_all_pairs_at_four_fifths(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(30))
    texts = [None, "", " \n", "one", "One", "two words", "a b c d", "a b c d e", "a b c d f"]
    for _ in range(40):
        w = [word() for _ in range(rng.randrange(20, 300))]
        texts.append(" ".join(w) + "\n" + line)
        for _ in range(3):  # about 0.6 to 1 of the shingles are left
            v = list(w)
            for at in rng.sample(range(len(v)), rng.randrange(0, 1 + len(v) // 20)):
                v[at] = word()
            texts.append(" ".join(v).upper() + " " + line)
    rng.shuffle(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, enumerate(texts)), "").collect()}
    assert kept == brute_firsts(dict(enumerate(texts)))
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), "").count() == 0


def test_stage_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in near_copies.dedup(docs).collect()} == brute_firsts(texts)


def test_stage_keeps_unlinked_texts_of_a_repeated_id(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(50)) for k in "xyz")
    rows = [(1, one), (2, one), (2, two), (2, two), (3, three), (3, one), (None, one), (None, one)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_copies.dedup(frame(spark, rows)).collect())
    assert kept == sorted([(0, one), (0, one), (1, one), (2, two), (3, three)])


def test_simhash_dedup_keeps_unlinked_texts_of_a_repeated_id(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(50)) for k in "xyz")
    rows = [(1, one), (2, one), (2, two), (2, two), (3, three), (3, one), (4, two), (4, three), (None, one)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.dedup(frame(spark, rows)).collect())
    assert kept == sorted([(0, one), (1, one), (2, two), (3, three)])


def test_wide_sketches_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(8)
    texts = []
    for n in (0, 1, 4, 30, 300, 3000, 12_000):
        words = [f"w{k}" for k in rng.integers(0, 500, n)]
        for change in (0.0, 0.01, 0.02, 0.2):
            texts.append(" ".join(f"x{k}" if rng.random() < change else w for k, w in enumerate(words)))
    nodes = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sketch = {r.id: bytes(r.sketch) for r in near_copies.wide_sketches(nodes).collect()}
    i, j = (x.tolist() for x in np.triu_indices(len(texts), 1))
    pick = lambda values, at: pa.array([values[k] for k in at])
    likely = near_copies.may_be_similar(pick(sketch, i), pick(sketch, j))
    alike = near_copies.similar(pick(texts, i), pick(texts, j))
    assert not (alike & ~likely).any() and alike.sum() > 10
    assert (likely & ~alike).sum() < 20  # and few others pass
