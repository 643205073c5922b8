"""Top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key; ``order`` must decide every tie.

    Each input partition passes on one row per key at most, so a key that holds
    a third of the table still reaches its task as a handful of rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every key, numbered from 1 in column ``rank``.

    Rows of a key are cut in two steps, first per (key, slice of the input) and
    then per key: as many slices as the shuffle has partitions, so the second step
    sees at most that many times ``n`` rows of a key. Up to n = 1000 Spark also cuts
    every input partition down before the first shuffle.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = salted.withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= n)
    ranked = (
        cut.withColumn("_n", F.row_number().over(final)).filter(F.col("_n") <= n).drop("_salt")
    )
    return ranked.withColumnRenamed("_n", rank) if rank else ranked.drop("_n")
