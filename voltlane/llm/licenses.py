"""License scans: places of license phrases, and short notices found with a bounded number of edits.

Texts are lower-cased (A-Z) and their words joined by single spaces. Base phrases are runs of
whole words. A notice also counts if a stretch that begins with a word, and ends anywhere,
differs from it by at most its number of edits (characters put in, taken out or replaced):

1. A notice with k edits is cut into k + 1 seeds. A stretch with at most k edits holds at
   least one of them unchanged, at most k characters from its place, so an Aho-Corasick
   search for all seeds at once finds every stretch that can match.
2. Around each hit the stretch that can hold the notice is cut out, and the `regex` library's
   bounded-error matching says whether and where the notice stands there, with fewest edits.
   Equal stretches are matched once and remembered.

Of matches of one notice that overlap the one with fewest edits stays, then the first.

Null texts count as empty: no words, no places, labels '', score 0. Very long texts are read
whole, with time in proportion to their length and hits; repeated rows get equal answers; an
empty table gives no rows. Ties: labels are sorted, and all of them are listed. Other columns
are kept; one named like the result is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.llm.common import text_blocks

#: Runs of words and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices: label, words, and the edits allowed.
NOTICES = (
    ("gpl", "gnu general public license", 2),
    ("gpl", "this program is free software you can redistribute it and or modify it", 5),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("apache", "apache license", 1),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("mit", "mit license", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5),
    ("mpl", "mozilla public license", 1),
    ("epl", "eclipse public license", 1),
    ("isc", "permission to use copy modify and or distribute this software", 4),
    ("unlicense", "free and unencumbered software released into the public domain", 4),
)
#: Bytes that separate words: all of ASCII but digits and small letters, once A-Z are small.
APART = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Stretches whose matches a Python worker remembers.
MEMO = 50_000

RESULT = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double, "
    "spans: array<struct<label: string, first_word: bigint, n_words: bigint, edits: bigint>>>"
)


def words(text: str) -> str:
    """The text's words between single spaces, one space at each end; ' ' if there is none."""
    found = text.encode().lower().translate(APART).split()
    return f" {b' '.join(found).decode()} " if found else " "


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 parts, each with its place."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """All notices' seeds in one automaton, and the matchers of the notices."""

    def __init__(self, notices: Sequence[tuple[str, str, int]] = NOTICES):
        self.notices = notices
        # one matcher for each number of edits: the library's own choice of the best match is not always the one with fewest edits
        self.matchers = [[regex.compile(rf"(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={n}}}") for n in range(edits + 1)] for _, text, edits in notices]
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(notices):
            for at, seed in seeds(text, edits):
                by_seed.setdefault(seed, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for seed, of in by_seed.items():
            self.automaton.add_word(seed, (len(seed), of))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def matched(self, k: int, stretch: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of notice k within the stretch, whose first character is context."""
        key = (k, stretch)
        if key not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            within = self.matchers[k]
            m = within[-1].search(stretch) and next(filter(None, (w.search(stretch) for w in within)))
            self.known[key] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
        return self.known[key]

    def matches(self, spaced: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of all notices in `words(text)`, by start."""
        tried, found = set(), {}
        for last, (size, of) in self.automaton.iter(spaced):
            for k, at in of:
                _, text, edits = self.notices[k]
                begin = last + 1 - size - at
                lo, hi = max(1, begin - edits), begin + len(text) + 2 * edits
                if (k, lo, hi) in tried:
                    continue
                tried.add((k, lo, hi))
                m = self.matched(k, spaced[lo - 1 : hi])
                if m:
                    found.setdefault(k, set()).add((m[2], lo - 1 + m[0], lo - 1 + m[1]))
        out = []
        for k, spans in found.items():
            out += [(start, end, k, edits) for edits, start, end in apart(spans)]
        return sorted(out)


def apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of each run of overlapping (edits, start, end) the best one, and the best of what is left beside it."""
    left, out = sorted(spans, key=lambda s: s[1:]), []
    while left:
        group, rest, end = [], [], -1
        kept: list[tuple[int, int, int]] = []
        for span in [*left, None]:
            if span is None or span[1] >= end:
                if group:
                    best = min(group)
                    kept.append(best)
                    rest += [s for s in group if s[2] <= best[1] or s[1] >= best[2]]
                group = []
            if span is not None:
                group.append(span)
                end = max(end, span[2])
        out += kept
        left = rest
    return out


@functools.lru_cache(4)
def scanner(notices: tuple[tuple[str, str, int], ...]) -> Scanner:
    return Scanner(notices)


def places(spaced: str, phrase: str) -> list[int]:
    """Where the phrase's words stand consecutively, as the position of the first word's space."""
    out, at = [], spaced.find(f" {phrase} ")
    while at >= 0:
        out.append(at)
        at = spaced.find(f" {phrase} ", at + 1)
    return out


def word_numbers(spaced: str, positions: list[int]) -> list[int]:
    """How many words begin before each of the ascending positions (of first letters)."""
    out, n, at = [], -1, 0
    for p in positions:
        n += spaced.count(" ", at, p)
        out.append(n)
        at = p
    return out


def scan_text(text: str, found: Scanner, phrases: Sequence[tuple[str, str]] = PHRASES) -> dict:
    spaced = words(text)
    n_words = spaced.count(" ") - 1
    base = sorted((at + 1, label) for phrase, label in phrases for at in places(spaced, phrase))
    at_word = word_numbers(spaced, [at for at, _ in base])
    base_labels = {label for _, label in base}
    near = found.matches(spaced)
    starts = word_numbers(spaced, [s for s, *_ in near])
    spans = [
        {"label": found.notices[k][0], "first_word": w, "n_words": spaced[s:e].strip().count(" ") + 1, "edits": edits}
        for (s, e, k, edits), w in zip(near, starts, strict=True)
    ]
    score = max([1 - edits / len(found.notices[k][1]) for _, _, k, edits in near] + [1.0] * bool(base), default=0.0)
    return {
        "n_words": n_words, "n_base": len(base), "first_word": at_word[0] if base else None, "last_word": at_word[-1] if base else None,
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {s["label"] for s in spans})), "score": score, "spans": spans,
    }


def scan(docs: DataFrame, out: str = "license", notices: Sequence[tuple[str, str, int]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """`docs` with a struct column `out`: counts, labels and score of the whole text, and the notices' spans in words."""
    notices = tuple(map(tuple, notices))

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        found = scanner(notices)
        rows = [scan_text(t, found, phrases) for block in text_blocks(texts) for t in block.to_pylist()]
        return pa.array(rows, KIND)

    return docs.withColumn(out, scanned.asNondeterministic()("text"))


KIND = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())])))]
)
