"""Token counts: pieces are counted once per distinct pre-token of the corpus, joined to each
document's pre-token frequencies, and summed; no ids are made for documents.

1. Every task gathers the distinct pre-tokens of its texts, the shuffle makes them distinct
   in the corpus, and the library counts the pieces of each once. The result is a table.
2. Counts of the most frequent pre-tokens, at most BROADCAST_TOKENS, go to all tasks (those of
   more than SHORT characters by their SHA-256, so a frequent long line costs no more), where each document sums count times frequency. So frequent
   pre-tokens never meet in one task, and few rows are shuffled: rows of (document,
   pre-token, frequency) exist for the rare rest alone, which is joined to the table.

Null texts count as empty (0 tokens); special strings are plain text, as the library takes
them; very long texts are read whole; repeated rows get equal counts and stay apart. An
empty table gives no rows. The text itself is not returned; other columns are kept, and one
named like the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlane.llm.common import text_blocks, written
from voltlane.llm.pieces import MARK, default_model, vocabulary

#: Pre-tokens whose counts are broadcast, at most, and how long they are as keys: 14 MB at most.
BROADCAST_TOKENS, SHORT = 200_000, 64
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHERED = 200_000
#: Bands of frequency by which the frequent pre-tokens are cut off, for each doubling.
BANDS = 16


def key(token: str) -> str:
    """What a pre-token is known by: itself, or its digest if it is long."""
    return token if len(token) <= SHORT else "sha256:" + hashlib.sha256(token.encode()).hexdigest()


def piece_counts(path: str, new: list[str]) -> list[int]:
    """The number of pieces of each pre-token, from the library."""
    model = vocabulary(path).model
    # the library puts a mark before each input; after a newline, which is a byte of its own,
    # a pre-token stands as it does inside a text
    guard = len(model.encode("\n"))
    found = model.encode(["\n" + p.replace(MARK, " ") for p in new], num_threads=1)
    return [len(f) - guard for f in found]


def pretokens(docs: DataFrame, path: str) -> DataFrame:
    """token (its key), n (pieces) and band (of its frequency; higher: more frequent) of every distinct pre-token, as a table."""

    def gather(batches):
        vocab, seen = vocabulary(path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "freq"])

        for batch in batches:
            for block in text_blocks(batch.column("text")):
                for text in block.to_pylist():
                    seen.update(vocab.pretokens(text))
                if len(seen) > GATHERED:
                    yield rows()
                    seen.clear()
        yield rows()

    @F.arrow_udf(T.LongType())
    def pieces(tokens: pa.Array) -> pa.Array:
        return pa.array(piece_counts(path, tokens.to_pylist()), pa.int64())

    found = docs.select("text").mapInArrow(gather, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    short = F.when(F.length("token") <= SHORT, F.col("token")).otherwise(F.concat(F.lit("sha256:"), F.sha2("token", 256)))
    return written(found.select(short.alias("token"), F.floor(F.log2("freq") * BANDS).cast("int").alias("band"), pieces("token").alias("n")), "pretokens")


def frequent(table: DataFrame, limit: int = BROADCAST_TOKENS) -> tuple[dict[str, int], DataFrame | None]:
    """Counts of the most frequent pre-tokens, at most `limit`, and the table of the others (None: there are none)."""
    sizes = table.groupBy("band").count().collect()  # some rows for each doubling of the frequency
    least, held = 1 << 30, 0
    for band, n in sorted(((r["band"], r["count"]) for r in sizes), reverse=True):
        if held + n > limit:
            break
        least, held = band, held + n
    common = F.col("band") >= least
    rows = table.where(common).select("token", "n").toArrow()
    counts = dict(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return counts, None if held == sum(r["count"] for r in sizes) else table.where(~common)


def count_tokens(docs: DataFrame, out: str = "n_tokens", model_path: str | None = None, broadcast: int = BROADCAST_TOKENS) -> DataFrame:
    """The columns of `docs` but the text, with a long column `out`: the number of tokens of the whole text."""
    path = model_path or default_model()
    counts, others = frequent(pretokens(docs, path), broadcast)
    known = docs.sparkSession.sparkContext.broadcast(counts)
    kept = [c for c in docs.columns if c not in ("text", out)]

    @F.arrow_udf("struct<n: bigint, rest: array<struct<token: string, times: bigint>>>")
    def looked_up(texts: pa.Array) -> pa.Array:
        vocab, have = vocabulary(path), known.value
        sums, rest = [], []
        for block in text_blocks(texts):
            for text in block.to_pylist():
                seen = Counter(map(key, vocab.pretokens(text)))
                sums.append(sum(have.get(p, 0) * k for p, k in seen.items()))
                rest.append([{"token": p, "times": k} for p, k in seen.items() if p not in have])
        return pa.StructArray.from_arrays([pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())])))], names=["n", "rest"])

    seen = docs.withColumn("__seen", looked_up.asNondeterministic()("text"))
    if others is None:
        return seen.select(*kept, F.col("__seen.n").alias(out))
    seen = written(seen.select(*kept, F.monotonically_increasing_id().alias("__row"), F.col("__seen.n").alias("__n"), F.col("__seen.rest").alias("__rest")), "token-sums")
    rest = seen.select(F.col("__row").alias("__of"), F.explode("__rest").alias("r")).select("__of", "r.token", "r.times")
    more = rest.join(others.select("token", F.col("n").alias("pieces")), "token").groupBy("__of").agg(F.sum(F.col("times") * F.col("pieces")).alias("__more"))
    done = seen.join(more, F.col("__row") == F.col("__of"), "left")
    return done.select(*kept, (F.col("__n") + F.coalesce("__more", F.lit(0))).alias(out))
