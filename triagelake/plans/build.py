"""From raw inputs to the tables that searches run on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.dedupe import SOURCE_RANK, combine_sources, dedupe_titles, default_sequence, latest_by_id
from triagelake.operators.embedding import DIMENSION, build_vectors
from triagelake.operators.profile import incident_stats
from triagelake.sources.incidents import read_incident_table, write_incidents
from triagelake.session import cut
from triagelake.sources.vectors import write_vectors


def build_tables(
    spark: SparkSession,
    sources: Sequence[tuple[int, DataFrame]],
    out: str,
    dedupe: bool = True,
    fn: Callable | None = None,
    dim: int = DIMENSION,
) -> tuple[DataFrame, PipelineModel | None]:
    """Combine sources, write incidents, vectors and embedder below ``out``.

    The last version of every id is kept; of versions equally late that of the source of
    highest rank, the last to be read. Statistics count those. Then, with ``dedupe``, one incident
    per title stays. Returns the statistics and the embedder.
    """
    versions = combine_sources(sources, dedupe=False, keep_rank=True)
    # Equal in time and source: the text decides, so that every run keeps the same version.
    text = F.xxhash64("title", "description")
    current = cut(latest_by_id(versions, [F.col("created_at"), F.col(SOURCE_RANK), text]), "current")
    stats = incident_stats(current)
    chosen = dedupe_titles(current, [F.col(SOURCE_RANK), *default_sequence()]) if dedupe else current
    write_incidents(chosen.drop(SOURCE_RANK), f"{out}/incidents")
    incidents = read_incident_table(spark, f"{out}/incidents")
    vectors, embedder = build_vectors(incidents, fn=fn, dim=dim)
    write_vectors(vectors, f"{out}/vectors")
    if embedder is not None:
        embedder.write().overwrite().save(f"{out}/embedder")
    return stats, embedder
