"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice's nodes are the positions of a text and its edges the pieces that match
there. For a BPE model a path is admissible if the merges keep each pair of neighbouring
pieces apart, that is, if the two pieces' joined string is encoded as just these two.
Every position then has one surviving path, and its last piece is the last piece of the
prefix's own encoding; so the path found is the library's encoding, which a search by
the sum of scores would not give (the scores of a BPE model are merge ranks). For a
unigram model the path with the largest sum of scores survives.

Only the last `longest piece` positions can begin a later edge. The search keeps the
pieces behind them and commits ids as soon as the surviving paths of all these positions
run through one boundary. Characters in no piece become byte pieces.

If no boundary is common yet, the window grows until one is; for a BPE model that takes a
text whose paths never meet, which merges do not leave (tests hold it to four pieces' length).

Pre-tokens of fewer characters than two longest pieces are read to their end before anything
is committed, so a block's new ones are searched in step with each other: each step looks at
one position of all of them, from the shortest last piece on, as the search of one stream does.

Null and empty texts have no ids; very long texts are streams, and equal texts give equal
ids. Decoding gives the text back but for the mark character itself, which the model cannot
tell from a space. An empty table gives no rows. Other columns are kept; one named like the
result is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm.common import BLOCK_BYTES, give_back, text_blocks
from voltlane.llm.pieces import MARK, Suffixes, Vocabulary, default_model, vocabulary

#: Pre-tokens and pairs that a Python worker remembers at most (about 200 MB); then it forgets the pre-tokens that it
#: met longest ago, or all pairs. In a pipeline, whose other stages leave their own memory behind, it remembers fewer.
MEMO, PAIR_MEMO = 600_000, 400_000
PIPELINE_MEMO, PIPELINE_PAIR_MEMO = 100_000, 100_000
#: Slots of the array of pairs (8 MB), where a pair replaces the one before in its slot, and streams that go in step at most.
PAIR_BITS, IN_STEP = 20, 1 << 15


class Encoder:
    """Encodes streams of characters with one vocabulary; remembers pairs and short pre-tokens."""

    def __init__(self, vocab: Vocabulary, unigram: bool = False, memo: int = MEMO, pair_memo: int = PAIR_MEMO):
        self.vocab, self.unigram, self.memo, self.pair_memo = vocab, unigram, memo, pair_memo
        self.tails = {p[i:] for p in vocab.ids for i in range(1, len(p))} - vocab.ids.keys()  # pieces are found before
        self.apart: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}  # ids as 32-bit integers, a quarter of a tuple's size
        self.older: dict[str, bytes] = {}  # those before; what is met again moves on to `seen`

    @cached_property
    def suffixes(self) -> Suffixes:
        return Suffixes(self.vocab.ids)

    @cached_property
    def pairs(self) -> np.ndarray:
        """Pairs as in `apart`, times two, plus one if they are kept apart; each in the slot that its hash gives."""
        return np.full(1 << PAIR_BITS, -1, np.int64)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best-scored neighbours, leftmost first."""
        ids, scores = self.vocab.ids, self.vocab.scores
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def keeps_apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= self.pair_memo:
                self.apart.clear()
            x, y = self.vocab.pieces[a], self.vocab.pieces[b]
            known = self.apart[key] = self.merged(x + y) == [x, y]
        return known

    def all_kept_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`keeps_apart` of arrays; true where `a` is no piece."""
        key = a.astype(np.int64) << 20 | b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        found = self.pairs[slot]
        none = a < 0
        apart = (found & 1 == 1) | none
        new = np.flatnonzero((found >> 1 != key) & ~none)
        if len(new):
            keys, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            got = np.fromiter((self.keeps_apart(k >> 20, k & (1 << 20) - 1) for k in keys.tolist()), bool, len(keys))
            self.pairs[slot[new[first]]] = keys << 1 | got
            apart[new] = got[of]
        return apart

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (marks in place of spaces), committed as early as possible."""
        vocab, longest = self.vocab, self.vocab.longest
        get, known, scores, unigram, tails = vocab.ids.get, self.apart.get, vocab.scores, self.unigram, self.tails
        text = ""  # the characters behind the positions that are kept
        # of each position: where its last piece begins, that piece's id (-1: no piece, -2: bytes), the path's score
        begin, last, score = [0], [-1], [0.0]
        end = 0
        for c in chars:
            text += c
            end += 1
            at, piece, best = -1, -2, 0.0
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                part = text[start:end]
                k = get(part)
                if k is None:
                    if part not in tails:
                        break  # no piece ends like this
                    continue
                if unigram:
                    if at < 0 or score[start] + scores[k] > best:
                        at, piece, best = start, k, score[start] + scores[k]
                    continue
                before = last[start]
                apart = before < 0 or known(before << 20 | k)
                if apart is None:
                    apart = self.keeps_apart(before, k)
                if apart:
                    at, piece = start, k
                    break
            if at < 0:
                at, best = end - 1, score[end - 1] - 20.0
            begin.append(at)
            last.append(piece)
            score.append(best)
            if end >= 2 * longest:
                cut = self._meeting(begin, end, longest)
                if cut:
                    yield from self._path(text, begin, last, cut)
                    text, end = text[cut:], end - cut
                    # the piece before the cut stays known as the last piece there
                    begin, last, score = [0] + [b - cut for b in begin[cut + 1 :]], last[cut:], score[cut:]
        yield from self._path(text, begin, last, end)

    @staticmethod
    def _meeting(begin: list[int], end: int, longest: int) -> int:
        """The last boundary that the paths of all positions in the window have in common; 0 if there is none."""
        tips = set(range(end - longest + 1, end + 1))
        while len(tips) > 1:
            far = max(tips)
            tips.discard(far)
            tips.add(begin[far])
        return tips.pop()

    def in_step(self, streams: list[str]) -> list[bytes]:
        """Ids of streams, longest first, none of which is long enough to commit before its end."""
        table, longest, n = self.suffixes, self.vocab.longest, len(streams)
        sizes = np.fromiter(map(len, streams), np.int64, n)
        first = np.cumsum(sizes) - sizes
        codes, top = table.encoded(streams), int(sizes[0])
        begin, last = np.zeros((top + 1, n), np.int32), np.full((top + 1, n), -1, np.int32)
        for end in range(1, top + 1):
            of = np.arange(np.searchsorted(-sizes, -end, side="right"))  # streams that reach this position
            begin[end, : len(of)], last[end, : len(of)] = end - 1, -2
            node = np.zeros(len(of), np.int32)
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                step = table.base[node] + codes[first[of] + start]
                more = table.behind[step] == node
                of, node = of[more], step[more]  # no piece ends like the others
                k = table.piece[node]
                at = np.flatnonzero(k >= 0)
                if len(at):
                    at = at[self.all_kept_apart(last[start, of[at]], k[at])]
                    begin[end, of[at]], last[end, of[at]] = start, k[at]
                    more = np.ones(len(of), bool)
                    more[at] = False
                    of, node = of[more], node[more]
                if not len(of):
                    break
        # paths are read from their ends
        path, count, odd = np.empty((top, n), np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        of, end = np.arange(n), sizes
        while len(of):
            k = last[end, of]
            path[count[of], of] = k
            count[of] += 1
            odd[of[k == -2]] = True
            end = begin[end, of]
            of, end = of[end > 0], end[end > 0]
        stop = np.cumsum(count)
        ids, step = np.empty(int(count.sum()), np.int32), 0
        while len(of := np.flatnonzero(count > step)):
            ids[stop[of] - 1 - step] = path[step, of]
            step += 1
        data, ends = ids.tobytes(), (stop * 4).tolist()
        rows = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero(odd).tolist():  # byte pieces
            rows[i] = array("i", self._path(streams[i], begin[:, i].tolist(), last[:, i].tolist(), len(streams[i]))).tobytes()
        return rows

    def _path(self, text: str, begin: list[int], last: list[int], end: int) -> list[int]:
        ids: list[int] = []
        while end > 0:
            start, k = begin[end], last[end]
            if k == -2:
                codes = [self.vocab.bytes.get(b, self.vocab.unknown) for b in text[start:end].encode()] if self.vocab.bytes else [self.vocab.unknown]
                ids += codes[::-1]
            else:
                ids.append(k)
            end = start
        return ids[::-1]

    def _recall(self, p: str) -> bytes | None:
        ids = self.seen.get(p)
        if ids is None:
            ids = self.older.pop(p, None)
            if ids is not None:
                self._remember(p, ids)
        return ids

    def _remember(self, p: str, ids: bytes) -> None:
        if len(p) <= 64:
            if len(self.seen) >= self.memo // 2:
                self.older, self.seen = self.seen, {}
            self.seen[p] = ids

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers: each pre-token is one stream, remembered if it is short."""
        out: list[bytes] = []
        for p in self.vocab.pretokens(text):
            ids = self._recall(p)
            if ids is None:
                ids = array("i", self.stream(p)).tobytes()
                self._remember(p, ids)
            out.append(ids)
        return b"".join(out)

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """`packed` of each text of a block; short pre-tokens that are not remembered go in step."""
        if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
            return [b"".join(chain.from_iterable(self._joined([some]) for some in self.vocab.pretoken_lists(texts[0])))]
        return self._joined([self.vocab.pretokens(t) for t in texts])

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens, joined."""
        distinct, seen = set(chain.from_iterable(lists)), self.seen
        ids = {p: seen[p] if p in seen else self._recall(p) for p in distinct}
        new = [p for p, k in ids.items() if k is None]
        short = [] if self.unigram else sorted((p for p in new if len(p) < 2 * self.vocab.longest), key=len, reverse=True)
        for i in range(0, len(short), IN_STEP):
            some = short[i : i + IN_STEP]
            ids.update(zip(some, self.in_step(some), strict=True))
        for p in new:
            if ids[p] is None:
                ids[p] = array("i", self.stream(p)).tobytes()
            self._remember(p, ids[p])
        return [b"".join(map(ids.__getitem__, tokens)) for tokens in lists]

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


class Decoder:
    """Text of ids: pieces joined, runs of byte pieces as UTF-8, marks as spaces, the first space dropped."""

    def __init__(self, vocab: Vocabulary):
        self.parts = [p.replace(MARK, " ").encode() for p in vocab.pieces]
        for b, i in vocab.bytes.items():
            self.parts[i] = bytes([b])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace")[1:]


_coders: dict[tuple[str, int, int], tuple[Encoder, Decoder]] = {}


def coders(path: str, memo: int = MEMO, pair_memo: int = PAIR_MEMO) -> tuple[Encoder, Decoder]:
    if (path, memo, pair_memo) not in _coders:
        _coders[path, memo, pair_memo] = Encoder(vocabulary(path), memo=memo, pair_memo=pair_memo), Decoder(vocabulary(path))
    return _coders[path, memo, pair_memo]


def encode(docs: DataFrame, out: str = "ids", model_path: str | None = None) -> DataFrame:
    """`docs` with an array<int> column `out`: the ids of the whole text."""
    path = model_path or default_model()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def to_ids(texts: pa.Array) -> pa.Array:
        return id_lists([row for block in text_blocks(texts) for row in coders(path)[0].packed_all(block.to_pylist())])

    # the optimizer may not copy it into each use of the ids, which would encode again for every one
    return docs.withColumn(out, to_ids.asNondeterministic()("text"))


def id_lists(rows: list[bytes]) -> pa.Array:
    sizes = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) // 4 for r in rows], out=sizes[1:])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32), pa.int32()))


def recode(docs: DataFrame, out: str = "coded", model_path: str | None = None, memo: int = MEMO, pair_memo: int = PAIR_MEMO) -> DataFrame:
    """`docs` with a struct column `out`: the ids of the whole text, and the text decoded from those ids.

    The same as `encode` and then `decode`, but one Python worker does both, so ids do not
    leave it and return, and only one worker a core remembers pre-tokens."""
    path = model_path or default_model()

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))
    def both(texts: pa.Array) -> pa.Array:
        encoder, decoder = coders(path, memo, pair_memo)
        parts = []
        for block in text_blocks(texts):
            rows = encoder.packed_all(block.to_pylist())
            back = pa.array((decoder.decode(array("i", r)) for r in rows), pa.string(), size=len(rows))
            parts.append(pa.StructArray.from_arrays([id_lists(rows), back], names=["ids", "text"]))
        give_back()
        return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([id_lists([]), pa.array([], pa.string())], names=["ids", "text"])

    return docs.withColumn(out, both.asNondeterministic()("text"))


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model_path: str | None = None) -> DataFrame:
    """`rows` with a string column `out`: the text that the ids stand for; null ids give ''."""
    path = model_path or default_model()

    @F.arrow_udf(T.StringType())
    def to_text(lists: pa.Array) -> pa.Array:
        decoder = coders(path)[1]
        return pa.array((decoder.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in lists), pa.string())

    return rows.withColumn(out, to_text(ids))
