"""Phrase mining against brute force over all phrases, however bad the sample and the filter are."""

import re
from collections import Counter

import numpy as np
import pytest

from voltlane.llm import phrases, queries

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, most=3, top=2000):
    f = Counter()
    for text, lang in rows:
        for piece in PIECE.split(low(text or "")):
            w = WORD.findall(piece)
            for size in range(1, most + 1):
                for i in range(len(w) - size + 1):
                    f[lang or "und", tuple(w[i : i + size])] += 1
    n = Counter()
    for (lang, p), k in f.items():
        n[lang] += k * (len(p) == 1)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in candidates.items():
        around = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 50 * a for b in around):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, rows in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def made(seed, n, words):
    rng = np.random.default_rng(seed)
    names = ["a", "B", "ç", "of", "the", "x-y", "\x00", "Ä ", "\x85", "'s", "longer"][:words]
    gaps = np.array([" ", "\t ", ". ", ",", "\n", "!"])
    return [("".join(names[i] + g for i, g in zip(rng.zipf(1.5, size) % words, rng.choice(gaps, size, p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05]), strict=True)), str(lang) if lang else None) for size, lang in zip(rng.integers(0, 60, n), rng.integers(0, 3, n), strict=True)]


@pytest.mark.parametrize(
    "seed, sampling",
    [(1, {}), (2, {"sample_of": 1 << 20}), (3, {"sample_of": 40, "sample_min": 3, "chunk": 200, "window": 7}), (4, {"sample_of": 2, "sample_min": 1, "bits": 64, "chunk": 1000}), (5, {"sample_of": 3, "sample_min": 8, "bits": 1 << 12})],
)
def test_matches_brute_force(spark, seed, sampling):
    rows = made(seed, 60, 11)
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs, **sampling).collect()]
    assert len(got) == len(set(got)) > 10
    assert set(got) == brute(rows)


def test_longer_phrases_and_fewer_results(spark):
    rows = made(9, 80, 6)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {tuple(r) for r in phrases.collocations(docs, least=6, most=4, top=15, sample_of=5, sample_min=4, chunk=500).collect()}
    assert got == brute(rows, least=6, most=4, top=15)


def test_failures_of_the_border_are_counted_in_further_passes(spark):
    # frequent words that a sample of no documents cannot propose: words, then pairs, then triples become possible
    docs = spark.createDataFrame([(k, "one two three four", "en") for k in range(12)], "doc_id long, text string, lang string")
    counts, passes = phrases.frequent_phrases(docs, sample_of=1 << 30)
    assert passes == 3
    assert {(r.phrase, r.n) for r in counts.where("size = 3").collect()} == {("one two three", 12), ("two three four", 12)}
    assert phrases.frequent_phrases(docs, sample_of=1, sample_min=1)[1] == 1


def test_counts_beyond_64_bits(spark):
    # a * a * 1000000 passes 64 bits from a = 3037001 on
    unit = "x y " * 2_000
    docs = spark.createDataFrame([(unit, "en")] * 8, "text string, lang string").selectExpr("repeat(text, 200) as text", "lang")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.collocations(docs).collect()}
    n, a = 3_200_000, 3_199_992
    assert got == {p: (a, n, n, 1000000 * a * a // (n * n)) for p in ("x y x", "y x y")}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), ("", "en", 2), ("..,\t\n", None, 3), ("a b. " * 10, None, 4), ("A\tb! " * 10, "und", 5), ("a b " * 5, "en", 6), ("a b " * 5, "en", 6)], "text string, lang string, phrase int")
    got = {tuple(r) for r in phrases.collocations(docs).collect()}
    assert got == brute([(r.text, r.lang) for r in docs.collect()])
    assert ("und", 1, "a b", 20, 20, 20, 40, 1000000) in got
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_same_as_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op13_phrase_mining"])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in queries.op13_phrase_mining(spark, sf).collect()) == sorted(cur.fetchall())


def test_a_full_task_hands_on_and_starts_anew(spark, monkeypatch):
    rows = made(6, 40, 11)
    monkeypatch.setattr(phrases, "HELD", 30)
    texts = {lang or "und": [t for t, x in rows if x == lang] for lang in {x for _, x in rows}}
    for lang, found in texts.items():
        tally, total, batches = phrases.Tally(lang, 3, None, None, True), Counter(), 0
        for text in found:
            tokens = text.encode().lower().translate(phrases.PIECES).replace(b".", b" . ").split()
            for k in range(0, len(tokens), 5):
                if tally.full(5):
                    batches += 1
                    for b in tally.rows(at_once=4):
                        total.update({(r["size"], r["phrase"]): 0 for r in b.to_pylist()})
                        for r in b.to_pylist():
                            total[r["size"], r["phrase"]] += r["n"]
                tally.add(tokens[k : k + 7], 5)
        for b in tally.rows():
            for r in b.to_pylist():
                total[r["size"], r["phrase"]] += r["n"]
        want = Counter()
        for text in found:
            for piece in PIECE.split(low(text)):
                w = WORD.findall(piece)
                want.update((s, " ".join(w[i : i + s])) for s in (1, 2, 3) for i in range(len(w) - s + 1))
                want[0, ""] += len(w)
        assert batches > 1 and +total == +want
