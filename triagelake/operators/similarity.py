"""Exact similarity search of whole query tables against a vector table.

Queries are ``(query_id, vec)``, the corpus is ``(id, vec)`` with one row per id.
Hits are ``(query_id, incident_id, score, rank)``, best first; equal scores are
ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from triagelake.operators.blocks import BlockTopK, RequestFilters, as_matrix
from triagelake.operators.conform import clamp_score, validate_inputs
from triagelake.operators.filters import Instant, filter_incidents, incident_predicate, lookup
from triagelake.operators.written import read_blocks, written_files
from triagelake.session import cut

# A task holds so much of the corpus, and meets it with all queries, so much of them at a time.
CORPUS_BYTES = 256 << 20
QUERY_BYTES = 64 << 20
# Corpora of many times this size are sampled first, for a floor under each query's last hit.
SAMPLE_ROWS = 20_000
SAMPLE_FROM = 50

# Columns by which a request brings filters of its own, and what they look at.
REQUEST_FILTERS = {"categories": "category", "severities": "severity", "after": "created_at", "before": "created_at"}
SHOWN_DECIMALS = 6

# Weak results are searched again with these allowances.
RELAX_THRESHOLD = 0.1
RELAX_EXTRA = 5
RELAX_BELOW = 2

# Terms of a search request that names none.
SEARCH_K = 10
SEARCH_THRESHOLD = 0.0


def topk_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    threshold: float = 0.0,
    exclude_self: bool = False,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` corpus rows of highest inner product for every query.

    Every query meets every vector, but pairs exist only inside a task as blocks of a
    matrix product, and vectors of the corpus stay where they are. A task passes on at
    most ``k`` rows per query for each portion of the corpus that it holds. Ranks and the
    threshold go by the score as it is; the score shown is rounded. `cells.topk_in_cells`
    gives the same rows and skips what cannot matter.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    terms = [F.lit(k).alias("_k"), F.lit(float(threshold)).alias("_threshold")]
    hits = topk_of_requests(queries.select("query_id", "vec", *terms), corpus, exclude_self, query_bytes)
    return hits.withColumn("score", shown(F.col("score")))


def topk_of_requests(
    requests: DataFrame, corpus: DataFrame, exclude_self: bool = False, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """The same for requests with terms of their own, with scores as they are.

    ``requests`` has query_id, vec, ``_k`` and ``_threshold``, and any of categories,
    severities (arrays), after and before (timestamps); the corpus then has the columns
    these look at. Queries are computed once and written to the shared folder; tasks of the
    corpus read them there, block by block, so neither the driver nor a task holds them all.
    """
    filters = [c for c in REQUEST_FILTERS if c in requests.columns]
    looked_at = sorted({REQUEST_FILTERS[c] for c in filters})
    corpus = corpus.select("id", F.col("vec").cast("array<float>").alias("vec"), *looked_at)
    own = [F.unix_micros(c).alias(c) if c in ("after", "before") else F.col(c) for c in filters]
    asked = requests.select("query_id", F.col("vec").cast("array<float>").alias("vec"), "_k", "_threshold", *own)
    asked = cut(asked, "queries")
    shape = asked.agg(F.max(F.size("vec")).alias("dim"), F.max("_k").alias("k")).first()
    row_bytes = 4 * max(shape["dim"] or 0, 0) + 100
    block_rows = max(1, query_bytes // row_bytes)

    def best(asked: DataFrame, corpus: DataFrame) -> DataFrame:
        found = _against_all(asked, corpus, exclude_self, block_rows)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("incident_id"))
        ranked = found.withColumn("rank", F.row_number().over(order))
        return ranked.where((F.col("rank") <= (shape["k"] or 1)) & (F.col("rank") <= F.col("_k")))

    rows = corpus.count()
    if rows > SAMPLE_FROM * SAMPLE_ROWS:
        # The k-th score among some of the corpus is at most the k-th among all.
        some = corpus.where(F.pmod(F.xxhash64("id"), F.lit(rows // SAMPLE_ROWS)) == 0)
        floors = best(asked, some).where("rank = _k").select("query_id", F.col("score").alias("_floor"))
        raised = F.greatest("_threshold", F.coalesce("_floor", "_threshold"))
        asked = cut(asked.join(floors, "query_id", "left").withColumn("_threshold", raised).drop("_floor"), "queries")
    return best(asked, corpus).select("query_id", "incident_id", "score", "rank")


def shown(score: Column) -> Column:
    """A score as results show it; nothing is compared by it."""
    return F.round(score, SHOWN_DECIMALS)


def _against_all(asked: DataFrame, corpus: DataFrame, exclude_self: bool, block_rows: int) -> DataFrame:
    """All written queries against each corpus partition in place."""
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("incident_id", corpus.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("_k", T.IntegerType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    files, columns = written_files(asked), asked.columns
    filtered = bool(set(columns) & set(REQUEST_FILTERS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in portions(batches, CORPUS_BYTES):
            parts = [
                (
                    batch.column("id"),
                    as_matrix(batch.column("vec")),
                    {c: batch.column(c) for c in batch.schema.names if c not in ("id", "vec")},
                )
                for batch in held
            ]
            for table in read_blocks(files, block_rows, columns):
                block = BlockTopK(
                    table["query_id"].combine_chunks(),
                    as_matrix(table["vec"]),
                    table["_k"].to_numpy(),
                    table["_threshold"].to_numpy(),
                    exclude_self,
                    RequestFilters(table) if filtered else None,
                )
                for part in parts:
                    block.add(*part)
                yield from block.result(arrow_schema).to_batches()

    return corpus.mapInArrow(search, schema)


def portions(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``most_bytes``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def similar_to_incidents(
    ids: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.0, exclude_self: bool = True
) -> DataFrame:
    """Neighbours of stored incidents, by their own vectors."""
    queries = lookup(corpus.select("id", "vec"), ids).withColumnRenamed("id", "query_id")
    return topk_similar(queries, corpus, k, threshold, exclude_self)


def retrieve(
    queries: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    threshold: float = 0.3,
    categories: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    after: Instant | None = None,
    before: Instant | None = None,
    mode: str = "prefilter",
) -> DataFrame:
    """Similar incidents that meet the filters, with their fields.

    mode="prefilter" searches among the allowed incidents only.
    mode="overfetch" takes the best ``3 k`` of all and keeps the allowed ones,
    which may give fewer than ``k`` rows although more would match.
    """
    filters = dict(categories=categories, severities=severities, after=after, before=before)
    filtered = incident_predicate(**filters) is not None
    if mode not in ("prefilter", "overfetch"):
        raise ValueError(f"unknown mode: {mode}")
    if not filtered:
        hits = topk_similar(queries, vectors, k, threshold)
    elif mode == "prefilter":
        hits = topk_similar(queries, allowed_vectors(vectors, incidents, filters), k, threshold)
    else:
        wide = topk_similar(queries, vectors, 3 * k, threshold)
        kept = attach_incidents(wide, filter_incidents(incidents, **filters))
        order = Window.partitionBy("query_id").orderBy("rank")
        return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return attach_incidents(hits, incidents)


def allowed_vectors(vectors: DataFrame, incidents: DataFrame, filters: dict) -> DataFrame:
    """Vectors of incidents that meet the filters.

    A vector table that carries the filter columns (see `build_vectors`) is
    filtered in its scan; otherwise the ids are matched.
    """
    needed = {
        "category": filters.get("categories"),
        "severity": filters.get("severities"),
        "created_at": filters.get("after") or filters.get("before"),
    }
    if all(value is None or name in vectors.columns for name, value in needed.items()):
        return filter_incidents(vectors, **filters)
    allowed = filter_incidents(incidents, **filters).select("id")
    return vectors.join(allowed, "id", "left_semi")


def retrieve_with_relaxation(
    queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.3
) -> DataFrame:
    """Search, and search once more on easier terms where fewer than two hits came.

    A query may bring ``top_k`` and ``similarity_threshold``; ``k`` and ``threshold`` stand
    in where it does not. One pass answers both searches: the easier one contains the
    strict one, so the strict hits are counted per query and decide which set to keep.
    """
    own_k = term(queries, "top_k", k).cast("int")
    own_threshold = term(queries, "similarity_threshold", threshold).cast("double")
    terms = cut(queries.select("query_id", "vec", own_k.alias("_own_k"), own_threshold.alias("_own_threshold")), "queries")
    easier = F.greatest(F.lit(0.0), F.col("_own_threshold") - RELAX_THRESHOLD)
    wide = topk_of_requests(
        terms.select("query_id", "vec", (F.col("_own_k") + RELAX_EXTRA).alias("_k"), easier.alias("_threshold")), corpus
    )
    strict = (F.col("rank") <= F.col("_own_k")) & (F.col("score") >= F.col("_own_threshold"))
    per_query = Window.partitionBy("query_id")
    return (
        wide.join(terms.drop("vec"), "query_id")
        .withColumn("_strict", F.count_if(strict).over(per_query))
        .filter(strict | (F.col("_strict") < RELAX_BELOW))
        .withColumn("attempts", F.when(F.col("_strict") < RELAX_BELOW, 2).otherwise(1))
        .withColumn("score", shown(F.col("score")))
        .drop("_strict", "_own_k", "_own_threshold")
    )


def term(requests: DataFrame, name: str, default: int | float) -> Column:
    """A request's own term, the default where it has none."""
    return F.coalesce(F.col(name), F.lit(default)) if name in requests.columns else F.lit(default)


def attach_incidents(hits: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incident fields of every hit; hits without an incident are dropped.

    Incidents have one row per id. The hits are written first, so their real size decides
    whether they are broadcast and the incidents read in place, or both shuffled.
    """
    fields = incidents.withColumnRenamed("id", "incident_id")
    return (
        fields.join(cut(hits, "hits"), "incident_id")
        .withColumn("score", clamp_score(shown(F.col("score"))))
        .select("query_id", "rank", "score", *fields.columns)
    )


def search_view(found: DataFrame) -> DataFrame:
    """The columns a search result shows."""
    return found.select(
        "query_id",
        "rank",
        "incident_id",
        "title",
        "category",
        "severity",
        F.col("score").alias("similarity_score"),
    )


def search(requests: DataFrame, incidents: DataFrame, vectors: DataFrame, **filters) -> tuple[DataFrame, DataFrame]:
    """``(found, rejected)`` for search requests with vectors.

    A request may bring ``top_k``, ``threshold`` and filters: categories, severities (arrays;
    empty allows nothing), after, before (inclusive). ``filters`` hold for all requests.
    Requests outside the input bounds are rejected with the reasons.
    """
    valid, rejected = validate_inputs(requests, "search")
    own = [c for c in REQUEST_FILTERS if c in requests.columns]
    terms = valid.select(
        "query_id",
        "vec",
        term(valid, "top_k", SEARCH_K).cast("int").alias("_k"),
        term(valid, "threshold", SEARCH_THRESHOLD).cast("double").alias("_threshold"),
        *[c for c in own if c in ("categories", "severities")],
        *[F.col(c).cast("timestamp").alias(c) for c in own if c in ("after", "before")],
    )
    corpus = allowed_vectors(vectors, incidents, filters) if filters else vectors
    missing = sorted({REQUEST_FILTERS[c] for c in own} - set(corpus.columns))
    if missing:
        corpus = corpus.join(incidents.select("id", *missing), "id")
    return search_view(attach_incidents(topk_of_requests(terms, corpus), incidents)), rejected
