"""The vector table: one row per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Replace ``path`` with the vectors.

    A table that carries category and time is laid out like the incidents: partitioned by
    category, sorted by time, so filtered searches skip folders and row groups.
    """
    if {"category", "created_at"} <= set(vectors.columns):
        laid_out = vectors.hint("rebalance", F.col("category")).sortWithinPartitions("category", "created_at")
        laid_out.write.mode("overwrite").partitionBy("category").parquet(path)
    else:
        vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Fails when there is no table at ``path``."""
    return spark.read.parquet(path)


def vector_count(vectors: DataFrame) -> DataFrame:
    """One row with the number of ``vectors``."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"))
