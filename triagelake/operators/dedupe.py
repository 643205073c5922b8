"""Union of sources and the two kinds of deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import title_key
from triagelake.operators.ranking import first_per_key

SOURCE_RANK = "source_rank"


def default_sequence() -> list[Column]:
    """Tables have no row order; time and id stand in for it."""
    return [F.col("created_at"), F.col("id")]


def latest_by_id(df: DataFrame, seq: Sequence[Column] | None = None) -> DataFrame:
    """The last version of every id. ``seq`` must tell versions apart."""
    order = [F.desc_nulls_last(c) for c in _names_or_columns(seq or [F.col("created_at")])]
    return first_per_key(df, ["id"], order)


def dedupe_titles(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """The first incident of every title, ignoring case and outer blanks."""
    return first_per_key(df, [title_key()], list(order) if order else default_sequence())


def combine_sources(
    sources: Sequence[tuple[int, DataFrame]],
    dedupe: bool = True,
    seq: Sequence[Column] | None = None,
    keep_rank: bool = False,
) -> DataFrame:
    """One table from several; on equal titles the source of lowest rank wins."""
    ranked = [df.withColumn(SOURCE_RANK, F.lit(rank)) for rank, df in sources]
    combined = ranked[0]
    for df in ranked[1:]:
        combined = combined.unionByName(df, allowMissingColumns=True)
    if dedupe:
        combined = dedupe_titles(combined, [F.col(SOURCE_RANK), *(seq or default_sequence())])
    return combined if keep_rank else combined.drop(SOURCE_RANK)


def _names_or_columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]
