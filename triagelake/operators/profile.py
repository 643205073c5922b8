"""Counts over incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import has_resolution
from triagelake.operators.filters import labelled_only


def incident_stats(df: DataFrame) -> DataFrame:
    """Rows ``(dimension, value, incidents, with_resolution, resolution_rate)``.

    Dimensions are total, category, severity and source. The table is counted
    once by all three columns together; the domains are small, so the totals
    come from a few hundred rows instead of four copies of every incident.
    """
    cells = df.groupBy("category", "severity", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_resolution()).alias("r")
    )
    views = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value"))
            for name in ["category", "severity", "source"]
        ],
    )
    counted = (
        cells.select(F.explode(views).alias("view"), "n", "r")
        .groupBy("view.dimension", "view.value")
        .agg(F.sum("n").alias("incidents"), F.sum("r").alias("with_resolution"))
    )
    return counted.withColumn("resolution_rate", F.try_divide("with_resolution", "incidents"))


def severity_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("incidents"))


def class_distribution(df: DataFrame, labelled: bool = True) -> DataFrame:
    """Incidents per category, by name."""
    rows = labelled_only(df) if labelled else df
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("incidents")).orderBy("category")
