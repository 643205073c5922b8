"""Golden cases and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.schema import GOLDEN_CASE_SCHEMA


def read_golden_cases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cases stored as an array under the key ``cases``."""
    schema = T.StructType([T.StructField("cases", T.ArrayType(GOLDEN_CASE_SCHEMA))])
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("cases").alias("case"))
        .select("case.*")
        .withColumnRenamed("id", "case_id")
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
