"""Tables of the operators: cut from their lineage, written once in buckets, or read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tagforge.sources.stage import ship_code, staged, staging_path, unstage

__all__ = ["chunks_written", "read_table", "ship_code", "staged", "staging_path", "unstage"]

#: Bytes of text that a bucket of chunks holds.
BUCKET_BYTES = 48 << 20


def chunks_written(dealt: DataFrame, key: str, total: int, name: str) -> DataFrame:
    """Rows written once, so that a row's chunk stays, and bucketed by it, so that grouping by chunk moves no text.

    Chunks are numbered by task, so a task writes only a few files; total is the size of all texts.
    """
    spark = dealt.sparkSession
    buckets = min(max(total // BUCKET_BYTES + 1, spark.sparkContext.defaultParallelism), 100_000)
    table = f"{name}_{uuid.uuid4().hex}"
    dealt.write.bucketBy(buckets, key).option("compression", "zstd").option("path", staging_path(spark, name)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: its files stay until the application ends
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
