import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from voltlane.llm import decontam


def hits(same, seed):
    return any(all(same[i + k] for k, bit in enumerate(seed) if bit == "1") for i in range(len(same) - len(seed) + 1))


def test_seeds_hit_every_placement():
    for n in range(12, 26):
        for wrong in range(n - decontam.least_equal(n, 0.8) + 1):
            for at in combinations(range(1, n - 1), wrong):
                same = [True] * n
                for i in at:
                    same[i] = False
                assert any(hits(same, s) for s in decontam.SEEDS), (n, at)
    for phase in range(6):
        assert any(hits([i % 6 != phase for i in range(60)], s) for s in decontam.SEEDS)


def brute_longest(same, least, share):
    found = [(b - a, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and b - a >= least and sum(same[a:b]) >= share * (b - a) - 1e-9]
    return max(found)[0] if found else 0


def test_longest_stretch_matches_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        p = rng.choice((0.5, 0.75, 0.85))
        same = [rng.random() < p for _ in range(rng.randrange(0, 45))]
        least = rng.choice((1, 5, 12))
        a, b = decontam.longest(np.array(same, bool), least, 0.8)
        assert b - a == brute_longest(same, least, 0.8)
        assert a == b or (same[a] and same[b - 1] and sum(same[a:b]) >= 0.8 * (b - a) - 1e-9)


def brute(docs, items):
    """(text, item) pairs that share an overlap, by trying all diagonals."""
    found = set()
    for d, w in enumerate(docs):
        for k, v in enumerate(items):
            for shift in range(-len(v) + 1, len(w)):
                same = [w[i] == v[i - shift] for i in range(max(0, shift), min(len(w), len(v) + shift))]
                if sum(same) > 1 and brute_longest(same, min(12, len(v)), 0.8):
                    found.add((d, k))
    return found


def find(docs, items):
    index = decontam.BenchmarkIndex(list(range(len(items))), [" ".join(v) for v in items])
    return {(d, k): (a, b, n) for d, k, a, b, n in index.overlaps(*decontam.words_of(pa.array([" ".join(w) for w in docs], pa.string())))}


def test_substituted_overlaps_match_brute_force():
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcd")
    items = [[word() for _ in range(n)] for n in (5, 7, 10, 11, 12, 13, 15, 15, 20, 24, 30, 40)]
    docs = []
    for v in items * 12:
        a = rng.randrange(0, max(1, len(v) - 14))
        part = [w if rng.random() < 0.82 else word() for w in v[a : a + rng.randrange(12, 41)]]
        docs.append([word() for _ in range(rng.randrange(6))] + part + [word() for _ in range(rng.randrange(6))])
    want = brute(docs, items)
    assert 30 < len(want) < len(docs) and find(docs, items).keys() == want


def test_part_of_a_poor_stretch_is_found():
    item = [f"w{i}" for i in range(40)]
    doc = item[:20] + [w if i % 2 else f"x{i}" for i, w in enumerate(item[20:])]
    a, b, n = find([doc], [item])[0, 0]
    assert a == 0 and b >= 20 and n >= 0.8 * (b - a)
    sixth = [w if i % 6 != 2 else f"x{i}" for i, w in enumerate(item)]
    assert find([sixth], [item])[0, 0][2] >= 32
