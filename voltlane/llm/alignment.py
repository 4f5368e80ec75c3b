"""Cross-tokenizer alignment: the tokens of two tokenizers are coalesced to groups of bytes.

A is a byte-level BPE over space + text, B a SentencePiece BPE over the text, which puts the
space there itself. Both cut the same bytes. All A and B tokens of a block of texts are
sorted by where they start (lexsort), `maximum.accumulate` of their ends says how far tokens
reach so far, and a group breaks where a start reaches that running maximum: there both
tokenizations end. Within a group every A token is linked to every B token.

1. Texts are encoded by pre-token, each once and then remembered, and aligned block by block
   in numpy. A table in the shared folder keeps each text's counts, digest and distinct
   linked id pairs, so texts are read and encoded once.
2. Spark counts in how many documents each id pair is linked, and each A id's highest count.
3. Counts of the most frequent pairs, at most BROADCAST_PAIRS (17 MB), go to all tasks, which
   sum them up over a document's pairs. So frequent pairs never meet in one task; rows of
   (document, pair) exist for the rare rest alone, which is joined to the counts.

Null and empty texts, and texts whose joined A or B bytes are not those of space + text (as
where a text holds B's own space mark), have no tokens: zeros and ''. Special tokens' strings
are plain text. Large groups are linked by their distinct ids, so their pairs are bounded by
the vocabularies. A very long text is a block of its own; repeated rows are documents of their
own; ties for the highest count all count as best; an empty table gives no rows. The text is
not returned; other columns are kept, and one named like a result is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import sys
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.llm.common import text_blocks, written
from voltlane.llm.pieces import MARK, default_model, vocabulary
from voltlane.llm.repair import byte_letters

A_MODEL = "byte_bpe_50k.json"
#: Pairs whose counts are broadcast at most, and bands of frequency by which they are chosen, for each doubling.
BROADCAST_PAIRS, BANDS = 1_000_000, 16
#: Pre-tokens that a worker remembers for each tokenizer, and the longest of them.
MEMO, SHORT = 300_000, 64
#: Links of a group from which on its ids are counted before they are paired.
LARGE = 4096
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))
ALIGNED = pa.struct([(n, pa.int64()) for n in RESULTS[:4]] + [("groups_sha256", pa.string()), ("links", LINKS)])
#: The tokenizer's own pattern in terms of `re`, for texts without ODD characters.
PRETOKENS = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def odd_characters() -> re.Pattern:
    """Characters that `re` takes for letters or spaces and the tokenizer does not, and those beyond the first plane."""
    odd = [c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("No", "Nl")]
    return re.compile(f"[\x1c-\x1f{re.escape(''.join(odd))}{chr(0x10000)}-{chr(sys.maxunicode)}]")


class Coder(dict):
    """Ids of pre-tokens as packed 32-bit integers, each encoded once, and each id's bytes.

    `wrong` has the remembered pre-tokens whose tokens' bytes are not their own."""

    def __init__(self, parts: list[bytes]):
        super().__init__()
        self.parts, self.lengths = parts, np.array([len(p) for p in parts], np.int64)
        self.digits = np.zeros((len(parts), len(str(len(parts))) + 1), np.uint8)
        self.n_digits = np.array([len(str(k)) for k in range(len(parts))])
        for k in range(len(parts)):
            self.digits[k, : self.n_digits[k]] = list(str(k).encode())
        self.wrong: set[str] = set()

    def __missing__(self, token: str) -> bytes:
        ids = self.ids_of(token)
        packed = array("i", ids).tobytes()
        if b"".join(map(self.parts.__getitem__, ids)) != self.bytes_of(token):
            self.wrong.add(token)
        elif len(token) <= SHORT:
            self[token] = packed
        return packed

    def encode(self, text: str) -> np.ndarray | None:
        """The ids of a text; None if their bytes are not those of space + text."""
        if len(self) > MEMO:
            self.clear()
        self.wrong.clear()
        ids = np.frombuffer(b"".join(map(self.__getitem__, self.pretokens(text))), np.int32)
        sure = not self.wrong and self.faithful(text)
        return ids if sure or b"".join(map(self.parts.__getitem__, ids.tolist())) == b" " + text.encode() else None

    def faithful(self, text: str) -> bool:
        """Whether the pre-tokens' bytes, one after the other, are those of space + text."""
        return True


class ByteCoder(Coder):
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters, self.odd = self.tokenizer.model, byte_letters(), odd_characters()
        of_letter = {c: b for b, c in self.letters.items()}
        entries = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(of_letter[c] for c in e) if all(c in of_letter for c in e) else e.encode() for e in entries])

    def ids_of(self, token: str) -> list[int]:
        return [t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(self.letters))]

    def bytes_of(self, token: str) -> bytes:
        return token.encode()

    def pretokens(self, text: str) -> list[str]:
        return PRETOKENS.findall(" " + text)

    def encode(self, text: str) -> np.ndarray | None:
        if not self.odd.search(text):
            return super().encode(text)
        ids = self.tokenizer.encode(" " + text, add_special_tokens=False).ids
        return np.array(ids, np.int32) if b"".join(map(self.parts.__getitem__, ids)) == b" " + text.encode() else None


class PieceCoder(Coder):
    """A SentencePiece model, whose marks are spaces and whose byte pieces are bytes."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        parts = [p.replace(MARK, " ").encode() for p in self.vocab.pieces]
        for b, k in self.vocab.bytes.items():
            parts[k] = bytes([b])
        super().__init__(parts)
        # the library puts a mark before each input; after a newline a pre-token stands as inside a text
        self.guard = len(self.vocab.model.encode("\n"))

    def ids_of(self, token: str) -> list[int]:
        return self.vocab.model.encode("\n" + token.replace(MARK, " "))[self.guard :]

    def bytes_of(self, token: str) -> bytes:
        return token.replace(MARK, " ").encode()

    def pretokens(self, text: str) -> list[str]:
        return self.vocab.pretokens(text)

    def faithful(self, text: str) -> bool:
        return MARK not in text


@functools.lru_cache(2)
def coders(a_path: str, b_path: str) -> tuple[Coder, Coder]:
    return ByteCoder(a_path), PieceCoder(b_path)


def ranks(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of successive runs of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, from 0 on; both cut the same stretch at the given ends."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([[0], a_ends[:-1], [0], b_ends[:-1]])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[order[1:]] = np.cumsum(starts[order[1:]] >= reach[:-1])
    return group[: len(a_ends)], group[len(a_ends) :]


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, times) of all links; ids stand group by group, n_a and n_b of them in each.

    Groups with many links come by distinct ids, so a pair has one row there."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    plain = n_a * n_b <= LARGE
    g = np.repeat(np.arange(len(n_a)), np.where(plain, n_a, 0))
    left = a[first_a[g] + ranks(np.where(plain, n_a, 0))]
    each = n_b[g]
    right = b[np.repeat(first_b[g], each) + ranks(each)]
    found = [(np.repeat(g, each), np.repeat(left, each), right, np.ones(len(right), np.int64))]
    for k in np.flatnonzero(~plain):
        x, p = np.unique(a[first_a[k] : first_a[k] + n_a[k]], return_counts=True)
        y, q = np.unique(b[first_b[k] : first_b[k] + n_b[k]], return_counts=True)
        found.append((np.full(len(x) * len(y), k), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(p, q).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def aligned_block(texts: list[str], coder_a: Coder, coder_b: Coder) -> pa.Array:
    """ALIGNED of each text of a block."""
    coded = [(coder_a.encode(t), coder_b.encode(t)) if t else (None, None) for t in texts]
    has = np.array([a is not None and b is not None for a, b in coded], bool)
    counts = np.zeros((4, len(texts)), np.int64)
    digests, sizes = [""] * len(texts), np.zeros(len(texts) + 1, np.int64)
    if not has.any():
        return result(counts, digests, sizes, *[np.zeros(0, np.int64)] * 3)
    sound = [c for c, h in zip(coded, has, strict=True) if h]
    tokens = [np.array([len(c[k]) for c in sound]) for k in (0, 1)]
    a, b = (np.concatenate([c[k] for c in sound]).astype(np.int64) for k in (0, 1))
    # texts stand one after the other, and both tokenizations end where a text does
    ga, gb = groups(np.cumsum(coder_a.lengths[a]), np.cumsum(coder_b.lengths[b]))
    n_groups = int(ga[-1]) + 1
    n_a, n_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    text_of = np.zeros(n_groups, np.int64)  # of each group
    text_of[ga] = np.repeat(np.arange(len(sound)), tokens[0])
    counts[0, has], counts[1, has] = tokens
    counts[2, has] = np.bincount(text_of, minlength=len(sound))
    counts[3, has] = np.bincount(text_of, n_a * n_b, len(sound)).astype(np.int64)
    for k, digest in zip(np.flatnonzero(has), group_digests(a, b, n_a, n_b, text_of, coder_a, coder_b), strict=True):
        digests[k] = digest
    g, left, right, times = links(a, b, n_a, n_b)
    wide = len(coder_b.parts)
    pairs, inverse = np.unique((text_of[g] * len(coder_a.parts) + left) * wide + right, return_inverse=True)
    n = np.bincount(inverse, times, len(pairs)).astype(np.int64)
    of, pair = np.divmod(pairs, len(coder_a.parts) * wide)
    sizes[1:][has] = np.bincount(of, minlength=len(sound))
    return result(counts, digests, np.cumsum(sizes), pair // wide, pair % wide, n)


def result(counts: np.ndarray, digests: list[str], offsets: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a, b, n)], names=["a", "b", "n"])
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)
    return pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(digests, pa.string()), lists], names=[f.name for f in ALIGNED])


def group_digests(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text_of: np.ndarray, coder_a: Coder, coder_b: Coder) -> list[str]:
    """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`."""
    begin = np.cumsum(n_a + n_b) - n_a - n_b
    place_a, place_b = np.repeat(begin, n_a) + ranks(n_a), np.repeat(begin + n_a, n_b) + ranks(n_b)
    width = max(coder_a.digits.shape[1], coder_b.digits.shape[1])
    chars, size = np.zeros((len(a) + len(b), width), np.uint8), np.zeros(len(a) + len(b), np.int64)
    for ids, place, coder in ((a, place_a, coder_a), (b, place_b, coder_b)):
        chars[place, : coder.digits.shape[1]] = coder.digits[ids]
        size[place] = coder.n_digits[ids]
    after = np.full(len(size), ord(","), np.uint8)
    after[begin + n_a - 1] = ord("|")
    after[begin + n_a + n_b - 1] = ord(";")
    chars[np.arange(len(size)), size] = after
    written_out = chars[np.arange(width) <= size[:, None]].tobytes()
    ends = np.cumsum(size + 1)
    last = np.flatnonzero(np.diff(text_of, append=-1))  # the last group of each text
    stops = ends[begin[last] + n_a[last] + n_b[last] - 1]
    return [hashlib.sha256(written_out[s : e - 1]).hexdigest() for s, e in zip([0, *stops[:-1]], stops, strict=True)]


def tokens_aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The columns of `docs` but the text and results, __row and a struct __seen of ALIGNED, as a table."""

    @F.arrow_udf("struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, links: array<struct<a: int, b: int, n: int>>>")
    def align(texts: pa.Array) -> pa.Array:
        a, b = coders(a_path, b_path)
        parts = [aligned_block(block.to_pylist(), a, b) for block in text_blocks(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], ALIGNED)

    kept = [c for c in docs.columns if c not in ("text", *RESULTS)]
    seen = docs.withColumn("__seen", align.asNondeterministic()("text"))
    return written(seen.select(*kept, F.monotonically_increasing_id().alias("__row"), "__seen"), "aligned")


def pair_counts(seen: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (n is A id's highest), band (of n); as a table."""
    counts = written(seen.select(F.explode("__seen.links").alias("x")).groupBy("x.a", "x.b").count().withColumnRenamed("count", "n"), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each entry of A's vocabulary at most
    best = counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"), F.floor(F.log2("n") * BANDS).cast("int").alias("band"))
    return written(best, "pair-counts")


def frequent(counts: DataFrame, limit: int) -> tuple[tuple[np.ndarray, ...], DataFrame | None]:
    """Keys (A id in the upper 32 bits), counts and best of the most frequent pairs, sorted by key, and the table of the others."""
    bands = sorted(((r["band"], r["count"]) for r in counts.groupBy("band").count().collect()), reverse=True)  # some rows for each doubling
    least, held = 1 << 30, 0
    for band, n in bands:
        if held + n > limit:
            break
        least, held = band, held + n
    rows = counts.where(F.col("band") >= least).select("a", "b", "n", "best").toArrow()
    key = rows.column("a").to_numpy().astype(np.int64) << 32 | rows.column("b").to_numpy()
    order = np.argsort(key)
    table = key[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy()[order]
    return table, None if held == sum(n for _, n in bands) else counts.where(F.col("band") < least)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """The columns of `docs` but the text, with those of RESULTS; one row for each row."""
    seen = tokens_aligned(docs, a_path or public_tokenizers.path(A_MODEL), b_path or default_model())
    table, others = frequent(pair_counts(seen), broadcast)
    known = docs.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in seen.columns if c not in ("__row", "__seen")]

    @F.arrow_udf("struct<n_best: bigint, count_sum: bigint, rest: array<struct<a: int, b: int, n: int>>>")
    def summed(lists: pa.Array) -> pa.Array:
        keys, n, best = known.value
        sizes = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        a, b, times = (x.to_numpy() for x in lists.flatten().flatten())
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        at = at[found]
        worth, good = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        worth[found], good[found] = n[at] * times[found], best[at] * times[found]
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[sizes])
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~found)])[sizes].astype(np.int32)), lists.flatten().filter(pa.array(~found)))
        return pa.StructArray.from_arrays([pa.array(per(good)), pa.array(per(worth)), rest], names=["n_best", "count_sum", "rest"])

    plain = ["__seen.n_a", "__seen.n_b", "__seen.n_groups", "__seen.n_links"]
    done = seen.withColumn("__sum", summed.asNondeterministic()("__seen.links"))
    if others is None:
        return done.select(*kept, *plain, "__sum.n_best", "__sum.count_sum", "__seen.groups_sha256")
    done = written(done.select(*kept, "__row", *plain, "__seen.groups_sha256", "__sum"), "alignment-sums")
    rest = done.select(F.col("__row").alias("__of"), F.explode("__sum.rest").alias("x")).select("__of", "x.a", "x.b", F.col("x.n").alias("__times"))
    more = rest.join(others.select("a", "b", "n", "best"), ["a", "b"]).groupBy("__of").agg(F.sum(F.col("__times") * F.col("n")).alias("__more"), F.sum(F.when(F.col("best"), F.col("__times")).otherwise(0)).alias("__good"))
    both = done.join(more, F.col("__row") == F.col("__of"), "left")
    return both.select(
        *kept, *[p.split(".")[1] for p in plain],
        (F.col("__sum.n_best") + F.coalesce("__good", F.lit(0))).alias("n_best"), (F.col("__sum.count_sum") + F.coalesce("__more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
