"""A training corpus from `documents`: rules, near-dedup, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a data frame; `run` writes it as Parquet
in the shared folder and reads it again as the next stage's docs, so a lost executor costs
one stage at most. All but the last stage return the columns of documents.

Rows with null or empty texts fail the fixed rules and go in the first stage. A null doc_id
is never dropped as a copy or as contaminated. A repeated doc_id keeps each of its different
texts; equal rows become one in near dedup. Very long texts are read whole. Columns beyond
those of documents pass through all stages but the last, which returns its own; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm import decontam, near_copies, pii, quality_rules, sp_codec
from voltlane.llm.common import BATCH, table, written

#: Bytes of one Arrow batch of a stage, where the session sets none. The JVM and a worker each hold a batch several times
#: over, and all stages run in the same executors.
BATCH_BYTES = "2m"


def in_small_batches(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(key, None) in (None, BATCH[key]):
            spark.conf.set(key, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the isolation forest reject go."""
    seen = quality_rules.assess(docs, table(spark, sf_dir, "labels"), "__quality")
    return seen.where("__quality.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class stays; texts whose five-word shingles are 0.8 similar are linked."""
    return near_copies.dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced by their kind."""
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text that they decode to."""
    coded = sp_codec.recode(docs.select("doc_id", "lang", "source", "text"), "__coded", memo=sp_codec.PIPELINE_MEMO, pair_memo=sp_codec.PIPELINE_PAIR_MEMO)
    return coded.select("doc_id", "lang", "source", "__coded.text", F.size("__coded.ids").cast("long").alias("n_pieces"), "__coded.ids")


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", benchmark_free), ("personal data", private), ("sentencepiece", tokens)]
STAGES = [(name, in_small_batches(stage)) for name, stage in STAGES]

#: SQL expresses neither the forest nor the token search; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
