"""Incident files: JSON lines in and out, Parquet as the main format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.conform import conform_incidents, require_valid, split_valid
from triagelake.schema import CORRUPT, INCIDENT_FILE_SCHEMA


def read_incidents(
    spark: SparkSession, path: str | list[str], mode: str = "quarantine", pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Read incident JSON lines as ``(valid, rejected)``.

    mode="quarantine" sets bad records aside with the reasons;
    mode="failfast" stops at the first one.
    """
    reader = (
        spark.read.schema(INCIDENT_FILE_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))
    checked = conform_incidents(raw)
    if mode == "failfast":
        checked = require_valid(checked)
    elif mode != "quarantine":
        raise ValueError(f"unknown mode: {mode}")
    return split_valid(checked)


def read_incident_dir(
    spark: SparkSession, path: str, pattern: str = "*.jsonl", mode: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """All files of a folder that match ``pattern``; ids repeat if files overlap."""
    return read_incidents(spark, path, mode=mode, pattern=pattern)


def write_incidents(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None) -> None:
    """Replace ``path`` with the rows.

    JSON lines are compressed only if asked for, as ``gzip`` for instance; file names then end in ``.json.gz``.

    Parquet is partitioned by category and sorted by time inside each file, so
    category filters prune folders and date filters skip row groups. The
    rebalance step splits categories that hold much of the data over several
    files and keeps small ones in a single file.
    """
    packed = {} if compression is None else {"compression": compression}
    if fmt == "json":
        # Text that is no JSON is kept as a JSON string.
        as_text = F.try_variant_get(F.parse_json(F.to_json(F.struct("metadata"))), "$.metadata", "variant")
        as_object = F.coalesce(F.try_parse_json("metadata"), as_text)
        df.withColumn("metadata", as_object).write.mode("overwrite").option(
            "ignoreNullFields", "false"
        ).options(**packed).json(path)
    elif fmt == "parquet":
        (
            df.hint("rebalance", F.col("category"))
            .sortWithinPartitions("category", "created_at")
            .write.mode("overwrite")
            .partitionBy("category")
            .options(**packed)
            .parquet(path)
        )
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_incident_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table written by `write_incidents`."""
    return spark.read.parquet(path)
