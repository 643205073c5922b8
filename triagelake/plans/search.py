"""Searches that start from text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import embedding_text
from triagelake.operators.conform import validate_inputs
from triagelake.operators.embedding import with_vectors
from triagelake.operators.similarity import retrieve, search


def search_texts(
    requests: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    embedder: PipelineModel | None = None,
    embed_fn: Callable | None = None,
    **filters,
) -> tuple[DataFrame, DataFrame]:
    """``(found, rejected)`` for ``(query_id, query)`` rows with the terms that `search` knows.

    Requests outside the input bounds are rejected with the reasons and never embedded.
    """
    valid, rejected = validate_inputs(requests, "search")
    asked = with_vectors(valid, F.col("query"), embedder, embed_fn)
    found, _ = search(asked, incidents, vectors, **filters)
    return found, rejected


def retrieve_for_incidents(
    wanted: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    threshold: float = 0.3,
    embedder: PipelineModel | None = None,
    embed_fn: Callable | None = None,
) -> DataFrame:
    """Similar incidents of incident rows, by their text. An incident may find itself."""
    texts = wanted.select(F.col("id").alias("query_id"), embedding_text().alias("_text"))
    queries = with_vectors(texts, F.col("_text"), embedder, embed_fn).drop("_text")
    return retrieve(queries, incidents, vectors, k, threshold)
