"""Tables from which a few ids are read without the rest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.filters import LISTED_IDS, lookup

# Small row groups: a lookup reads at least one of those that may hold its id.
GROUP_BYTES = 8 << 20


def write_points(df: DataFrame, path: str, append: bool = False, group_bytes: int = GROUP_BYTES) -> None:
    """Write rows clustered by ``id``, with a Bloom filter of the ids of every row group.

    Ranges of ids fall to files, so the least and greatest id of a row group tell most lookups
    that it is none of theirs. Rows appended later bring files of ranges of their own, which overlap the
    older ones; there the Bloom filters tell. Ranges are cut by id and then by content, so an id
    that fills a third of the table is still spread over files. Ids may repeat or be null.
    """
    others = [F.xxhash64(F.to_json(F.struct(F.col(f"`{c}`")))) for c in df.columns if c != "id"]
    (
        df.repartitionByRange("id", F.xxhash64(*others) if others else F.lit(0))
        .sortWithinPartitions("id")
        .write.mode("append" if append else "overwrite")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.block.size", str(group_bytes))
        .parquet(path)
    )


def lookup_points(spark: SparkSession, path: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows of a table of `write_points` that have the given ids; unknown and null ids give no row.

    Up to ``LISTED_IDS`` different ids are compared one by one in the scan, the only form for which row
    groups are held against their Bloom filters. More ids are joined.
    """
    stored = spark.read.parquet(path)
    if isinstance(ids, DataFrame):
        few = [r["id"] for r in ids.select("id").where("id is not null").distinct().limit(LISTED_IDS + 1).collect()]
        if len(few) > LISTED_IDS:
            return lookup(stored, ids)
        ids = few
    wanted = list(dict.fromkeys(i for i in ids if i is not None))
    if not wanted:
        return stored.where(F.lit(False))
    if len(wanted) > LISTED_IDS:
        return lookup(stored, wanted)
    return stored.where(reduce(lambda a, b: a | b, [F.col("id") == F.lit(i) for i in wanted]))


def scan_report(df: DataFrame) -> dict[str, int]:
    """Runs ``df`` and says how many rows its scans had to read and how many rows came out.

    For plans without a shuffle, as those of `lookup_points` for few ids are. Rows of row groups
    and pages that were skipped do not count as read.
    """
    execution = df._jdf.queryExecution()
    out = execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    read = 0
    for i in range(leaves.size()):
        rows = leaves.apply(i).metrics().get("numOutputRows")
        read += rows.get().value() if rows.isDefined() else 0
    return {"rows_read": read, "rows_out": out}
