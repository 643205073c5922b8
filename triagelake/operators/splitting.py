"""Stratified train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut

_PREFIX = 3  # hex digits of the digest: 4096 slices per class


def stratified_split(
    df: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    label: str = "category",
    id_col: str = "id",
) -> DataFrame:
    """Add ``is_test``: in every class, the ``round(test_size * n)`` rows whose
    digest of id and seed is smallest.

    The digest of the last test row of each class is found first, by counting
    digests per slice and ranking only the slice the quota ends in. Splitting
    is then one comparison per row, so classes are never gathered or sorted
    whole and the rows themselves are not shuffled.
    """
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    keyed = df.select(
        F.col(label).alias("_label"),
        digest.alias("_digest"),
        F.col(id_col).alias("_id"),
        F.substring(digest, 1, _PREFIX).alias("_slice"),
    )
    slices = keyed.groupBy("_label", "_slice").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_slice")
    whole = Window.partitionBy("_label")
    border = (
        slices.withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_quota", F.round(F.lit(test_size) * F.sum("_n").over(whole)).cast("bigint"))
        .filter((F.col("_end") >= F.col("_quota")) & (F.col("_end") - F.col("_n") < F.col("_quota")))
        .select(
            F.col("_label").alias("_class"),
            F.col("_slice").alias("_border"),
            (F.col("_quota") - F.col("_end") + F.col("_n")).alias("_need"),
        )
    )
    # One row per class. Written, so that its real size decides how it is joined.
    border = cut(border, "split-border")
    position = F.row_number().over(Window.partitionBy("_label").orderBy("_digest", "_id"))
    last = (
        keyed.join(border, F.col("_label").eqNullSafe(F.col("_class")) & (F.col("_slice") == F.col("_border")))
        .withColumn("_position", position)
        .filter(F.col("_position") == F.col("_need"))
        .select("_label", F.col("_digest").alias("_last_digest"), F.col("_id").alias("_last_id"))
    )
    last = cut(last, "split-last")
    inside = (digest < F.col("_last_digest")) | (
        (digest == F.col("_last_digest")) & (F.col(id_col) <= F.col("_last_id"))
    )
    return (
        df.join(last, df[label].eqNullSafe(F.col("_label")), "left")
        .withColumn("is_test", F.coalesce(inside, F.lit(False)))
        .drop("_label", "_last_digest", "_last_id")
    )
