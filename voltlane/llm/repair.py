"""Token-id files with Re-Pair grammar compression.

Documents are dealt by doc_id ranges and sorted, each text is encoded, id 1 ends it, and
every BLOCK_IDS ids or so become one shard: frequent pairs of ids are replaced by
nonterminals round after round, first inside words (pairs are counted over the shard's
distinct words, weighted by their frequency), then across words of a document. A shard
stores its rules, the length that each rule expands to, and where each document's
symbols begin, so one document can be decoded without the others.

File format: a Parquet table in the shared folder with one row per shard:
part, block (order within the part), first_doc, n_ids, doc_ids, n_tokens, symbol_starts,
rules (pairs, flat), rule_lengths, sequence (symbols as little-endian unsigned 16 bits, or
32 bits if `wide`). Symbols below `base` are ids, the others rules in order.

Null texts count as empty and hold the end id alone; rows with null doc_id come first;
rows with equal doc_id go by text. A very long text is a shard of its own or the last of
one. An empty table gives no shards. Only doc_id and text are read, other columns are not.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.llm.common import scratch

MODEL = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 2_000_000
#: Rounds inside words and across words, pairs replaced a round, and how often a pair must occur.
WORD_ROUNDS, STREAM_ROUNDS, PAIRS, LEAST = 10, 2, 1024, 32
#: Words that a Python worker remembers at most; between shards it forgets all but the most used quarter, of those used twice.
MEMO = 800_000

SCHEMA = (
    "part int, block int, first_doc long, n_ids long, doc_ids array<long>, n_tokens array<int>, symbol_starts array<int>, "
    "base int, rules array<int>, rule_lengths array<int>, wide boolean, sequence binary"
)


# Latin-1 text without apostrophes splits into pre-tokens by these classes of the tokenizer's own pattern.
LETTERS, NUMBERS, SPACES = "a-z\u00df-\u00f6\u00f8-\u00ff\u00aa\u00b5\u00ba", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
MARKS = ".,;:!?"
PRETOKENS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}{SPACES}]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCoder:
    """Ids of words, each encoded once. Words are cut at ASCII white space, which no token crosses.

    Code c stands for the ids flat[begin[c]:begin[c + 1]]. Words that are one pre-token share
    its code, so spellings that differ in capitals alone are one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = "".join(byte_letters()[b] for b in range(256))
        self.base = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes(self)
        self.parts: dict[str, int] = {}
        self.flat, self.begin = array("i"), array("q", [0])
        self.uses = np.zeros(0, np.int64)

    def count(self, freq: np.ndarray) -> None:
        """Adds how often each code was used."""
        freq[: len(self.uses)] += self.uses
        self.uses = freq

    def forget(self, most: int) -> None:
        """Keeps the `most` used codes, of those used twice, with their words; what was used long ago counts half."""
        uses = np.zeros(len(self.begin) - 1, np.int64)
        uses[: len(self.uses)] = self.uses
        kept = np.flatnonzero(uses >= 2)
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(-uses[kept], most)[:most]])
        begin, flat = np.array(self.begin, np.int64), np.array(self.flat, np.int32)
        sizes = begin[kept + 1] - begin[kept]
        ends = np.cumsum(sizes)
        flat = flat[np.arange(int(sizes.sum())) + np.repeat(begin[kept] - ends + sizes, sizes)]
        number = np.full(len(uses), -1, np.int64)
        number[kept] = np.arange(len(kept))
        number = number.tolist()
        codes = _Codes(self)
        codes.update((w, number[k]) for w, k in self.codes.items() if number[k] >= 0)
        self.parts = {p: number[k] for p, k in self.parts.items() if number[k] >= 0}
        self.codes, self.flat, self.begin = codes, array("i", flat.tobytes()), array("q", np.append(0, ends).tobytes())
        self.uses = uses[kept] // 2

    def code(self, ids) -> int:
        self.flat.extend(ids)
        self.begin.append(len(self.flat))
        return len(self.begin) - 2

    def part_code(self, part: str) -> int:
        """The code of a lower-case pre-token."""
        # the model alone is quicker than the whole tokenizer, whose other steps are done here
        letters = part if part.isascii() and part.isprintable() else codecs.charmap_decode(part.encode(), "strict", self.letters)[0]
        k = self.parts[part] = self.code([t.id for t in self.model.tokenize(letters)])
        return k

    def joined(self, parts: Iterable[str]) -> int:
        """The code of several pre-tokens in a row."""
        flat, begin, known = self.flat, self.begin, self.parts.get
        codes = [k if (k := known(p)) is not None else self.part_code(p) for p in parts]
        for k in codes:
            flat.extend(flat[begin[k] : begin[k + 1]])
        begin.append(len(flat))
        return len(begin) - 2

    def word_code(self, word: str) -> int:
        if word.isascii():
            low = word.lower()
            if word.isalpha():
                k = self.parts.get(low)
                return k if k is not None else self.part_code(low)
            # most others are letters and marks
            head = low.rstrip(MARKS)
            if head.isalpha():
                return self.joined((head, low[len(head) :]))
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return self.code(self.tokenizer.encode(word, add_special_tokens=False).ids)
            low = word.lower()
        if "'" in word or "<|" in word:
            return self.code(self.tokenizer.encode(word, add_special_tokens=False).ids)
        parts = PRETOKENS.findall(low)
        if len(parts) == 1:
            k = self.parts.get(parts[0])
            return k if k is not None else self.part_code(parts[0])
        return self.joined(parts)

    def codes_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The codes of the words of each text, in order; every distinct word is looked up once. Null texts have none."""
        # white space at the ends would split off empty words
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
        flat = words.flatten().dictionary_encode()
        # as an array of objects, which is quicker to make than a list of scalars
        distinct = flat.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        codes = np.frombuffer(array("q", [self.codes[w] if w else -1 for w in distinct]), np.int64)[flat.indices.to_numpy()]
        sizes = pc.list_value_length(words).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        # a text without words is one empty word
        return [codes[a:z] if z - a != 1 or codes[a] >= 0 else codes[:0] for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


class _Codes(dict):
    """Codes by word; a new word gets its code when it is asked for."""

    def __init__(self, coder: WordCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: bytes) -> int:
        code = self[word] = self.coder.word_code(word.decode())
        return code


def top_pairs(symbols: np.ndarray, joined: np.ndarray, weights: np.ndarray | None, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of frequent pairs, which pair each is); pairs are (symbols[i], symbols[i+1]) where joined[i]."""
    at = np.flatnonzero(joined)
    if not len(at) or most <= 0:
        return at[:0], at[:0]
    key = symbols[at].astype(np.int64) << 32 | symbols[at + 1]
    # rare pairs are sorted out by a hashed count first
    bucket = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
    rough = np.bincount(bucket, None if weights is None else weights[at], 1 << 20)
    likely = rough[bucket] >= least
    at, key = at[likely], key[likely]
    pairs, inverse = np.unique(key, return_inverse=True)
    count = np.bincount(inverse, None if weights is None else weights[at], len(pairs))
    rank = np.full(len(pairs), -1, np.int64)
    best = np.argsort(-count, kind="stable")[:most]
    best = best[count[best] >= least]
    rank[best] = np.arange(len(best))
    chosen = rank[inverse] >= 0
    return at[chosen], rank[inverse][chosen]


def replaced(symbols: np.ndarray, at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the pairs at positions `at` replaced, leftmost first where pairs overlap; and which symbols stay."""
    start = np.ones(len(at), bool)
    start[1:] = np.diff(at) > 1
    run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    take = (np.arange(len(at)) - run) % 2 == 0
    symbols = symbols.copy()
    symbols[at[take]] = new[take]
    stay = np.ones(len(symbols), bool)
    stay[at[take] + 1] = False
    return symbols, stay


def compress(flat: np.ndarray, begin: np.ndarray, doc_codes: list[np.ndarray], base: int, rounds=(WORD_ROUNDS, STREAM_ROUNDS), most=PAIRS, least=LEAST) -> dict:
    """Re-Pair over documents given as codes of words; code c stands for flat[begin[c]:begin[c + 1]]."""
    codes = np.concatenate(doc_codes) if doc_codes else np.zeros(0, np.int64)
    # the words of this shard, by first code; a table is quicker than a sort
    uses = freq = np.bincount(codes, minlength=len(begin) - 1)
    used = np.flatnonzero(freq)
    number = np.zeros(len(freq), np.int64)
    number[used] = np.arange(len(used))
    codes, freq = number[codes], freq[used]
    sizes = begin[used + 1] - begin[used]
    jump = np.cumsum(sizes) - sizes
    symbols = flat[np.arange(int(sizes.sum())) - np.repeat(jump, sizes) + np.repeat(begin[used], sizes)].astype(np.int64)
    word = np.repeat(np.arange(len(used)), sizes)
    rules: list[np.ndarray] = []
    n = base

    def one_round(symbols, owner, weights):
        nonlocal n
        joined = owner[1:] == owner[:-1]
        at, rank = top_pairs(symbols, joined, weights, most, least)
        if not len(at):
            return None
        first = np.zeros(int(rank.max()) + 1, np.int64)
        first[rank] = at
        rules.append(np.stack([symbols[first], symbols[first + 1]], axis=1))
        symbols, stay = replaced(symbols, at, rank + n)
        n += len(first)
        return symbols[stay], owner[stay]

    for _ in range(rounds[0]):
        done = one_round(symbols, word, freq[word].astype(float))
        if done is None:
            break
        symbols, word = done
    # the documents' streams: each word's symbols, and the end id
    sizes = np.bincount(word, minlength=len(used)) if len(used) else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    n_words = np.array([len(d) for d in doc_codes], np.int64)
    length = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    jump = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(jump, length) + np.repeat(begin[codes] if len(codes) else codes, length)
    doc = np.repeat(np.repeat(np.arange(len(doc_codes)), n_words), length)
    symbols = symbols[inner]
    ends = np.searchsorted(doc, np.arange(len(doc_codes)), side="right")
    symbols, doc = np.insert(symbols, ends, END_ID), np.insert(doc, ends, np.arange(len(doc_codes)))
    for _ in range(rounds[1]):
        done = one_round(symbols, doc, None)
        if done is None:
            break
        symbols, doc = done
    rules_flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths = np.ones(n, np.int64)
    for k, (a, b) in enumerate(rules_flat.tolist()):
        lengths[base + k] = lengths[a] + lengths[b]
    return {"symbols": symbols, "starts": np.searchsorted(doc, np.arange(len(doc_codes))), "rules": rules_flat, "lengths": lengths[base:], "uses": uses, "tokens": np.bincount(doc, lengths[symbols], len(doc_codes)).astype(np.int64) if len(doc) else np.zeros(len(doc_codes), np.int64)}


class Grammar:
    """A shard's rules, expanded once to flat arrays."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.base = base
        self.length = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
        self.start = np.concatenate([np.arange(base), base + np.cumsum(lengths) - lengths]).astype(np.int64)
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), np.zeros(int(lengths.sum()), np.uint32)])
        for k, (a, b) in enumerate(rules.reshape(-1, 2).tolist()):
            at, la = self.start[base + k], self.length[a]
            self.flat[at : at + la] = self.flat[self.start[a] : self.start[a] + la]
            self.flat[at + la : at + self.length[base + k]] = self.flat[self.start[b] : self.start[b] + self.length[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols."""
        length = self.length[symbols]
        jump = np.cumsum(length) - length
        return self.flat[np.arange(int(length.sum())) - np.repeat(jump, length) + np.repeat(self.start[symbols], length)]


_coders: dict[str, WordCoder] = {}


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of whole texts, in ascending doc_id order, as compressed shards below `path`."""
    tokenizer_path = tokenizer_path or public_tokenizers.path(MODEL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _coders:
            _coders[tokenizer_path] = WordCoder(tokenizer_path)
        coder = _coders[tokenizer_path]
        part, block, ids, codes, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            c = compress(np.array(coder.flat, np.int32), np.array(coder.begin, np.int64), codes, coder.base)
            coder.count(c["uses"])
            wide = coder.base + len(c["rules"]) > 1 << 16
            row = {
                "part": part, "block": block, "first_doc": ids[0], "n_ids": int(c["tokens"].sum()), "doc_ids": ids, "n_tokens": c["tokens"].tolist(), "symbol_starts": c["starts"].tolist(), "base": coder.base,
                "rules": c["rules"].ravel().tolist(), "rule_lengths": c["lengths"].tolist(), "wide": wide, "sequence": c["symbols"].astype("<u4" if wide else "<u2").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            while at < len(names):
                for words in coder.codes_of(batch.column("text").slice(at)):
                    codes.append(words)
                    ids.append(names[at])
                    at += 1
                    size += 3 * len(words) + 1
                    if size >= block_ids:
                        yield shard()
                        block, ids, codes, size = block + 1, [], [], 0
                        if len(coder.codes) > MEMO:
                            coder.forget(MEMO // 4)
                            break  # codes are other ones now
        if ids:
            yield shard()

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(pack, SCHEMA).write.parquet(path)


ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("symbol_starts", pa.list_(pa.int32())),
    ("base", pa.int32()), ("rules", pa.list_(pa.int32())), ("rule_lengths", pa.list_(pa.int32())), ("wide", pa.bool_()), ("sequence", pa.binary()),
])


def _symbols(row: dict) -> np.ndarray:
    return np.frombuffer(row["sequence"], "<u4" if row["wide"] else "<u2").astype(np.int64)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, block, at (ids before it in the shard), n_tokens, ids_crc32; decoded from the files alone."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar(row["base"], np.array(row["rules"], np.int64), np.array(row["rule_lengths"], np.int64))
                symbols = _symbols(row)
                ids = memoryview(grammar.expand(symbols).astype("<u4").tobytes())
                before = np.concatenate([[0], np.cumsum(grammar.length[symbols])])
                begin = before[row["symbol_starts"]]
                sizes = np.diff(np.append(begin, before[-1]))
                sums = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(begin, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "part", "block", "at", "n_tokens", "ids_crc32"],
                )

    return spark.read.parquet(path).mapInArrow(unpack, "doc_id long, part int, block int, at long, n_tokens long, ids_crc32 long")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block, start: the ids before each shard. Parts are summed first, so one task sees a row per part only."""
    shards = spark.read.parquet(path).select("part", "block", "first_doc", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min_by("first_doc", "block").alias("first"))
    before = Window.orderBy(F.asc_nulls_first("first"), "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("inner")).alias("start"))


def token_index(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes the shards of `docs` and reads back doc_id, start, n_tokens and ids_crc32 of every document."""
    spark = docs.sparkSession
    path = scratch(spark, "token-shards")
    write_shards(docs, path, tokenizer_path)
    found = read_shards(spark, path).join(shard_starts(spark, path), ["part", "block"])
    return found.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document: only its own symbols are expanded."""
    row = spark.read.parquet(path).where((F.col("first_doc") <= doc_id) & F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        return []
    k = row["doc_ids"].index(doc_id)
    bounds = [*row["symbol_starts"], len(row["sequence"]) // (4 if row["wide"] else 2)]
    grammar = Grammar(row["base"], np.array(row["rules"], np.int64), np.array(row["rule_lengths"], np.int64))
    return grammar.expand(_symbols(row.asDict())[bounds[k] : bounds[k + 1]]).tolist()
