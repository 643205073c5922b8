"""The whole analysis: classify, search, prompt, ask, check, assemble."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import query_text
from triagelake.operators.classify import classify
from triagelake.operators.embedding import with_vectors
from triagelake.operators.generation import MAX_ROUNDS, Responder, generation_rounds, results
from triagelake.operators.prompts import DEFAULT_TEMPLATE, build_prompts
from triagelake.operators.similarity import attach_incidents, retrieve_with_relaxation
from triagelake.session import cut


def analyze(
    queries: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    fn: Responder,
    k: int = 5,
    threshold: float = 0.3,
    max_rounds: int = MAX_ROUNDS,
    model: PipelineModel | None = None,
    embedder: PipelineModel | None = None,
    embed_fn=None,
    template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """Analysis results for ``(query_id, title, description)`` rows, one per query.

    Queries are embedded with ``embedder`` or ``embed_fn`` unless they bring a
    column ``vec``. A query's own ``top_k`` and ``similarity_threshold`` go before
    ``k`` and ``threshold``. The model behind ``fn`` is sent each query's prompt at most
    ``max_rounds`` times.
    """
    judged = classify(queries, model)
    if "vec" not in judged.columns:
        judged = with_vectors(judged, query_text(), embedder, embed_fn)
    judged = cut(judged, "queries")
    hits = retrieve_with_relaxation(judged, vectors, k, threshold)
    found = cut(attach_incidents(hits, incidents), "found")
    answers = generation_rounds(build_prompts(judged, found, template), fn, max_rounds)
    return assemble(judged, found, results(answers))


def assemble(judged: DataFrame, found: DataFrame, answered: DataFrame) -> DataFrame:
    """Join the three parts of a result by query; each hit carries its whole incident."""
    fields = [c for c in found.columns if c not in ("query_id", "rank", "score")]
    item = F.struct("rank", F.col("score").alias("similarity_score"), *fields)
    similar = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item)).alias("similar_incidents")  # short: hits of one query
    )
    empty = F.array().cast(similar.schema["similar_incidents"].dataType)
    return (
        judged.select(
            "query_id",
            F.col("title").alias("query_title"),
            F.col("description").alias("query_description"),
            "predicted_category",
            "predicted_severity",
            "category_confidence",
        )
        .join(similar, "query_id", "left")
        .withColumn("similar_incidents", F.coalesce("similar_incidents", empty))
        .join(answered, "query_id")
        .drop("response", "passed")
    )
