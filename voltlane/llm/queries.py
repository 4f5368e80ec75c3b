"""The registered queries of the training-data operators, one opN_<name> each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm import alignment, chat, decontam, langid, licenses, phrases, pii, quality_gbt, quality_rules, repair, simhash, sp_codec, token_count
from voltlane.llm.common import in_training, table
from voltlane.llm.pieces import MARK


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, "__language")
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "__language.lang_pred", "__language.score")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = F.replace("text", F.lit(MARK), F.lit(" "))
    coded = sp_codec.recode(docs)
    return coded.select("doc_id", F.size("coded.ids").cast("long").alias("n_pieces"), F.xxhash64("coded.ids").alias("ids_hash"), (F.col("coded.text") == plain).alias("round_trip"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"r'\### Assistant: </turn> ok'"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {hard}), (-7L, 1L, 'assistant', {hard}) AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_chats(rows.unionByName(more)))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = token_count.count_tokens(docs.select("doc_id", "text", n_bytes))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_index(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = quality_rules.assess(docs, table(spark, sf_dir, "labels"), "__quality")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return seen.select("doc_id", *[f"__quality.{c}" for c in columns], F.col("__quality.anomaly").alias("anomaly"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_gbt.classify(docs, table(spark, sf_dir, "labels"), "__score")
    held_out = (~in_training(F.col("doc_id"))).alias("held_out")
    return scored.select("doc_id", held_out, F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "__license")
    return found.select("doc_id", "__license.*")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_token_count": op5_token_count,
    "op6_token_files": op6_token_files,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_alignment": op11_token_alignment,
    "op12_license_scan": op12_license_scan,
    "op13_phrase_mining": op13_phrase_mining,
}

#: In SQL a turn is escaped if its rendering would not be read back: it holds a control string, escaped or not.
OP4_SQL = r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 t AS (SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') THEN regexp_replace(text, '(\\*(?:###|</turn>))', '\\\1', 'g') ELSE text END AS body FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(length(role) + length(body) + 15)::BIGINT AS formatted_chars, true AS round_trip FROM t GROUP BY 1"""

OP13_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
 grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
 f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
 c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= 10),
 inner2 AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3),
 gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner2 i ON i.lang = c.lang AND i.phrase = c.phrase WHERE c.size = 2 AND 100 * i.a >= 50 * c.a),
 cuts AS (SELECT c.*, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : size], ' ') AS y FROM c ANTI JOIN gone USING (lang, phrase), (VALUES (1), (2)) s(k) WHERE k < size),
 scored AS (SELECT cuts.*, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(n)::BIGINT FROM f WHERE f.lang = ranked.lang AND size = 1) AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op4_chat_format": OP4_SQL, "op13_phrase_mining": OP13_SQL}
