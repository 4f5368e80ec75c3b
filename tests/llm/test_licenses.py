"""License scans against brute force: all stretches of whole words, with a table of edits each."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voltlane.llm import licenses, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCAN = licenses.Scanner()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def edits(notice, text):
    """The fewest edits between the notice and a prefix of the text."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(notice, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def brute(text, phrases=licenses.PHRASES, notices=licenses.NOTICES):
    found = WORDS.findall(low(text))
    base = sorted((k, label) for phrase, label in phrases for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split())
    least = {}
    for n, (_, notice, most) in enumerate(notices):
        for i in range(len(found)):
            part = " ".join(found[i : i + len(notice) + most])[: len(notice) + most]
            # letters that the notice has and the text has not cost an edit each
            if sum((Counter(notice) - Counter(part)).values()) <= most and (d := edits(notice, part)) <= most:
                least[n] = min(least.get(n, most), d)
    base_labels = {label for _, label in base}
    return {
        "n_words": len(found), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {notices[n][0] for n in least})),
        "score": max([1 - d / len(notices[n][1]) for n, d in least.items()] + [1.0] * bool(base), default=0.0),
    }


def check(text):
    got, want = licenses.scan_text(text, SCAN), brute(text)
    assert {k: got[k] for k in want} == want, text
    found = WORDS.findall(low(text))
    for s in got["spans"]:
        part = " ".join(found[s["first_word"] : s["first_word"] + s["n_words"]])
        assert any(label == s["label"] and edits(notice, part) == s["edits"] <= most for label, notice, most in licenses.NOTICES)


@st.composite
def noisy(draw):
    """Words, and notices with a few characters changed, put in or taken out."""
    parts = []
    for _ in range(draw(st.integers(1, 4))):
        if draw(st.booleans()):
            parts.append(draw(st.sampled_from(["the lease", "Zäune, x", "cc by", "submit license", "MIT", "gnu", "license mit license mit license", "\x7f.."])))
            continue
        _, text, most = draw(st.sampled_from(licenses.NOTICES))
        for _ in range(draw(st.integers(0, most + 1))):
            at = draw(st.integers(0, len(text) - 1))
            text = text[:at] + draw(st.sampled_from(["", "x", "é", " ", text[at] * 2, "-"])) + text[at + 1 :]
        parts.append(text)
    return draw(st.sampled_from([" ", "\n", "x"])).join(parts)


@settings(max_examples=150, deadline=None)
@given(noisy())
def test_matches_brute_force(text):
    check(text)


@pytest.mark.parametrize("text", ["", "...", "MIT License", "mit-license MIT LICENSE; mit license", "Released under the M1T Licence.", "summit license", "Licensed under CC BY 4.0", "gnu general public licens", "gnu genral publik license apache licence"])
def test_small_texts(text):
    check(text)


def test_notices_with_one_edit_too_many():
    assert licenses.scan_text("apoche licenze", SCAN)["labels"] == ""
    assert licenses.scan_text("apache licenze", SCAN)["labels"] == "apache"


def test_query_on_the_table(spark, sf):
    rows = queries.op12_license_scan(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    seeds = [s for _, n, e in licenses.NOTICES for _, s in licenses.seeds(n, e)]
    for r in rows:
        spaced = licenses.words(texts[r.doc_id])
        # brute force is slow: only over the stretches near some seed's occurrence, else no notice can match
        want = brute(texts[r.doc_id], notices=licenses.NOTICES if any(s in spaced for s in seeds) and len(spaced) < 20_000 else ())
        assert {k: r[k] for k in want if k != "score"} == {k: v for k, v in want.items() if k != "score"}
    assert sum(r.labels != "" for r in rows) >= 3


def test_odd_rows(spark):
    long = "lorem " * 50_000 + "mit license"
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "MIT License", None), (2, long, "z"), (2, long, "z")], "doc_id long, text string, license string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == 5
    assert sorted((r.doc_id or 0, r.license.n_words, r.license.n_base, r.license.first_word, r.license.labels) for r in rows if r.license.n_words) == [(0, 2, 1, 0, "mit"), (2, 50_002, 1, 50_000, "mit"), (2, 50_002, 1, 50_000, "mit")]
    assert [(r.license.n_base, r.license.first_word, r.license.labels, r.license.score) for r in rows if not r.license.n_words] == [(0, None, "", 0.0)] * 2
    assert licenses.scan(docs.limit(0)).count() == 0
