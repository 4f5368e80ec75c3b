"""Writers: idempotent per-run tables, captures and merged reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.operators.catalog import upsert


def replace_runs(df: DataFrame, path: str) -> None:
    """Writes rows below one folder per run; runs that are in `df` are replaced whole, others stay."""
    df.repartition("run_id").sortWithinPartitions("run_id", "seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_capture(messages: DataFrame, path: str) -> None:
    """Messages (seq, recv_s, raw) as gzipped captures in arrival order."""
    line = F.concat(F.format_string("%.6f", "recv_s"), F.lit("\t"), F.col("raw"))
    messages.repartitionByRange("seq").sortWithinPartitions("seq").select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def merge_table(spark: SparkSession, path: str, new: DataFrame, key: list[str], out: str, keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """The table at `path` with `new` put over it, written to `out` (tables here are immutable) and read back."""
    upsert(spark.read.parquet(path), new, key, keep_old_if_null).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two reference tables hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def seed(spark: SparkSession, path: str, rows: DataFrame, replace: bool = False) -> bool:
    """Loads reference rows once: nothing to do if they are there, an error if others are there and `replace` is off."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.write.parquet(path)
        return True
    if same_rows(old, rows):
        return False
    if not replace:
        raise ValueError(f"{path} holds other rows; replace=True overwrites them")
    rows.write.mode("overwrite").parquet(path)
    return True
