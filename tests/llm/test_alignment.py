"""Alignment against the libraries' whole encodings and plain loops over tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltlane.llm import alignment, queries
from voltlane.llm.repair import byte_letters

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = {c: b for b, c in byte_letters().items()}


def tokens(text):
    a = [(k, bytes(BYTES[c] for c in A.id_to_token(k))) for k in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for k in B.encode(text):
        p = B.id_to_piece(k)
        b.append((k, bytes([int(p[3:5], 16)]) if B.is_byte(k) else p.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def brute(texts):
    rows, linked = [], []
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        ends = [set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (a, b)]
        groups, left, right, i, j, at_a, at_b = [], [], [], 0, 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            left, right = [], []
            while at_a < end:
                left.append(a[i][0])
                at_a += len(a[i][1])
                i += 1
            while at_b < end:
                right.append(b[j][0])
                at_b += len(b[j][1])
                j += 1
            groups.append((left, right))
        text_form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        pairs = [(x, y) for p, q in groups for x in p for y in q]
        linked.append(pairs)
        rows.append([len(a), len(b), len(groups), len(pairs), hashlib.sha256(text_form.encode()).hexdigest() if a else ""])
    count = Counter(p for pairs in linked for p in set(pairs))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [(*r[:4], sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), r[4]) for r, pairs in zip(rows, linked, strict=True)]


PARTS = st.sampled_from(["the", " The", "  ", "\n", "\r\n\t", "ünï", "12 345", "½²", "\x1c", "don't", "'S", "<|endoftext|>", "<s>", "<0x41>", "▁", "漢字", "😀", "\x00", "é", "a" * 70, "-" * 90, " .", "_x", "\xa0", "​", "ǅ"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.lists(PARTS, max_size=12).map("".join), st.text(max_size=30)), min_size=1, max_size=4))
def test_blocks_match_brute_force(texts):
    got = alignment.aligned_block(texts, *alignment.coders(public_tokenizers.path("byte_bpe_50k.json"), alignment.default_model())).to_pylist()
    want = brute(texts)
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in got] == [(*w[:4], w[6]) for w in want]
    assert [sum(x["n"] for x in r["links"]) for r in got] == [w[3] for w in want]


def test_large_groups_link_distinct_ids(monkeypatch):
    a, b = np.array([1, 2, 1, 7, 7]), np.array([5, 5, 6, 9])
    n_a, n_b = np.array([3, 2]), np.array([3, 1])

    def total():
        found = Counter()
        for g, x, y, n in zip(*alignment.links(a, b, n_a, n_b), strict=True):
            found[int(g), int(x), int(y)] += int(n)
        return found

    every = total()
    monkeypatch.setattr(alignment, "LARGE", 2)
    assert total() == every == {(0, 1, 5): 4, (0, 1, 6): 2, (0, 2, 5): 2, (0, 2, 6): 1, (1, 7, 9): 2}


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 300, 0])
def test_table_matches_brute_force(spark, sf, broadcast):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows]), strict=True)}
    found = alignment.align(docs, broadcast=broadcast)
    assert found.columns == ["doc_id", *alignment.RESULTS]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


def test_query(spark, sf):
    rows = queries.op11_token_alignment(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.n_best <= r.n_links <= r.count_sum for r in rows)


def test_odd_rows(spark):
    texts = [None, "", "ok then", "ok then", "a▁b", "x" * 300_000 + " \n" * 1000]
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)] + [(None, "ok then", None, 9)], "doc_id long, text string, n_a string, links int")
    found = alignment.align(docs)
    assert found.columns == ["doc_id", "links", *alignment.RESULTS]
    got = {r.links: tuple(r)[2:] for r in found.collect()}
    want = brute([*texts, "ok then"])
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 9)] == want
    assert got[0] == got[1] == got[4] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.align(docs.limit(0)).count() == 0
