"""Pre-tokens of a SentencePiece BPE vocabulary, and what both of its operators share.

With the vocabulary's white-space mark in place of spaces, no piece holds the mark after
another character, none joins a letter to a digit or sign, and newline is in none and stands
alone as a byte. So merges never cross a cut before a run of marks, between letters and
other characters, or beside a newline, and the pieces of a text are those of its
pre-tokens, in order. `Vocabulary` checks each claim when it loads a model and cuts
only where it holds.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import sentencepiece

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Pre-tokens of a long text that are held at once.
HELD = 1 << 17
#: Places among the others that are tried for a suffix's steps, before they go to the end.
TRIALS = 16


class Vocabulary:
    """A loaded model: piece ids by string, byte pieces, and the pre-token pattern."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not self.model.is_byte(i)}
        self.scores = [self.model.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.ids))
        self.unknown = self.model.unk_id()
        self.cuts = re.compile(self._pattern())

    def _pattern(self) -> str:
        """Pre-tokens as this vocabulary allows: no piece may cross from one to the next."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return "(?s).+"
        lone = "" if any("\n" in p for p in self.ids) else "\n"
        # letters that some piece joins to a sign or digit count as signs
        odd = re.escape("".join(sorted({c for p in self.ids for c in re.findall(rf"[^\W\d_](?=[^\w{MARK}]|[\d_])|(?:(?<=[^\w{MARK}])|(?<=[\d_]))[^\W\d_]", p)})))
        letter, sign = rf"[^\W\d_{odd}]", rf"[^\w{MARK}]|[\d_{odd}]"
        if len(odd) > 100 or any(re.search(rf"{letter}(?:{sign})|(?:{sign}){letter}", p) for p in self.ids):
            return f"{lone or '(?!)'}|{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+"
        other = rf"(?:[^\w{MARK}{lone}]+|[\d_{odd}]+)+"
        # most pre-tokens are a word of these letters, which the next alternative finds sooner than the general ones
        common = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(letter, c))
        word = f"{MARK}[{common}]++(?!{letter})"
        return f"{word}|{lone or '(?!)'}|{MARK}+(?:{letter}+|{other})?|{letter}+|{other}"

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text as the library normalises it: spaces are marks, one mark goes first."""
        return self.cuts.findall(MARK + text.replace(" ", MARK)) if text else []

    def pretoken_lists(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a long text, some at a time."""
        found = (m[0] for m in self.cuts.finditer(MARK + text.replace(" ", MARK))) if text else iter(())
        while some := list(islice(found, HELD)):
            yield some


class Suffixes:
    """The suffixes of all pieces as arrays, to walk back from many positions at once.

    A suffix is a slot, the empty one slot 0. With one more character in front it is slot `base` + the character's code,
    if that slot's `behind` is the slot that the step came from. `piece` is the id of a suffix that is a piece, else -1."""

    def __init__(self, ids: dict[str, int]):
        codes = {c: i for i, (c, _) in enumerate(Counter(c for p in ids for c in p).most_common(), 1)}
        longer = defaultdict(list)
        for s in {p[i:] for p in ids for i in range(len(p))}:
            longer[s[1:]].append((codes[s[0]], s))
        self.codes = np.zeros(max(map(ord, codes), default=0) + 2, np.int32)  # 0: in no piece
        self.codes[[*map(ord, codes)]] = [*codes.values()]
        slots, bases, used = {"": 0}, {}, bytearray(b"\1")
        for s in sorted(longer, key=lambda s: (len(s), -len(longer[s]), s)):
            steps = sorted(longer[s])
            at = 0
            for trial in range(TRIALS + 1):
                at = used.find(0, at) if trial < TRIALS else len(used)
                base = (at if at >= 0 else len(used)) - steps[0][0]
                used.extend(bytes(max(0, base + steps[-1][0] + 1 - len(used))))
                if not any(used[base + c] for c, _ in steps):
                    break
                at += 1
            bases[slots[s]] = base
            for c, t in steps:
                slots[t], used[base + c] = base + c, 1
        n = len(used) + len(codes) + 1  # a step may look that far beyond
        self.base, self.behind, self.piece = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.base[[*bases]] = [*bases.values()]
        for s, steps in longer.items():
            self.behind[[slots[t] for _, t in steps]] = slots[s]
        self.piece[[slots[p] for p in ids]] = [*ids.values()]

    def encoded(self, texts: Iterable[str]) -> np.ndarray:
        """The codes of the characters of all texts, one after another."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.codes[np.minimum(chars, len(self.codes) - 1)]


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_model() -> str:
    return public_tokenizers.path(MODEL)
