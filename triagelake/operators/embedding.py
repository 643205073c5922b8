"""Text to unit vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import embedding_text
from triagelake.operators.conform import require_rows
from triagelake.operators.ranking import first_per_key

WORD = r"[\p{L}\p{N}_]{2,}"
TOKEN = re.compile(r"\w{2,}")  # the same words
# Most words of a large corpus are rare, so a task remembers the places of a bounded number of them.
REMEMBERED_WORDS = 1 << 16
# Texts of a batch that are Python objects at a time.
PIECE_ROWS = 256
DIMENSION = 384
BATCH_SIZE = 32

VECTOR_FILTER_COLUMNS = ["category", "severity", "created_at"]


def fit_embedder(texts: DataFrame, text_col: str = "text", dim: int = DIMENSION) -> PipelineModel:
    """Hashed TF-IDF vectors: no vocabulary is kept, so the size stays fixed.

    A word's place is the first 32 bits of its MD5 modulo ``dim``, which other engines
    compute alike. One pass: each task counts in how many texts a place occurs, and the
    counts of all tasks, ``dim`` numbers each, are added.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, place_of = np.zeros(dim, np.int64), 0, word_places(dim)
        for batch in batches:
            for texts in pieces(batch.column(0)):
                for text in texts:
                    found[list({place_of(w) for w in words_of(text)})] += 1
            rows += batch.num_rows
        yield pa.RecordBatch.from_pydict({"place": np.arange(dim + 1), "texts": np.append(found, rows)})

    counts = texts.select(text_col).mapInArrow(count, "place long, texts long")
    total = {r["place"]: r["n"] for r in counts.groupBy("place").agg(F.sum("texts").alias("n")).collect()}  # a row per place
    documents = total.get(dim, 0)
    weights = [math.log((documents + 1.0) / (total.get(i, 0) + 1.0)) for i in range(dim)]
    places = (
        f"SELECT *, transform(_words, w -> cast(cast(conv(substr(md5(w), 1, 8), 16, 10) AS bigint) % {dim} AS string)) AS _places "
        "FROM __THIS__"
    )
    return PipelineModel(
        [
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=WORD, gaps=False),
            SQLTransformer(statement=places),
            CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], "_places", "_tf"),
            ElementwiseProduct(scalingVec=DenseVector(weights), inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
        ]
    )


def pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, some at a time."""
    for start in range(0, len(texts), PIECE_ROWS):
        yield texts.slice(start, PIECE_ROWS).to_pylist()


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def word_places(dim: int) -> Callable[[str], int]:
    """The place of a word; those of a bounded number of words are remembered."""
    known: dict[str, int] = {}

    def place(word: str) -> int:
        found = known.get(word)
        if found is None:
            if len(known) >= REMEMBERED_WORDS:
                known.clear()
            found = known[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % dim
        return found

    return place


def embed(df: DataFrame, embedder: PipelineModel, text_col: str = "text", out: str = "vec") -> DataFrame:
    """Add the vector of ``text_col``, which must be the column the embedder was fitted on.

    A built-in embedder is its weights; texts become vectors in one step, in Arrow batches.
    Any other pipeline that ends in ``_unit`` is run stage by stage.
    """
    weights = built_in_weights(embedder)
    if weights is not None:
        return df.withColumn(out, _hashed_vectors(weights)(F.col(text_col)))
    return (
        embedder.transform(df)
        .withColumn(out, vector_to_array("_unit", "float32"))
        .drop("_words", "_places", "_tf", "_tfidf", "_unit")
    )


def built_in_weights(embedder: PipelineModel) -> np.ndarray | None:
    """The weights of an embedder of `fit_embedder`, None for any other."""
    scaled = [s for s in embedder.stages if isinstance(s, ElementwiseProduct) and s.getOutputCol() == "_tfidf"]
    return scaled[0].getScalingVec().toArray() if len(scaled) == 1 and len(embedder.stages) == 5 else None


def _hashed_vectors(weights: np.ndarray):
    dim = len(weights)

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place_of = word_places(dim)
        for texts in chain.from_iterable(map(pieces, batches)):
            counts = np.zeros((len(texts), dim))
            for row, text in zip(counts, texts, strict=True):
                row += np.bincount(np.array([place_of(w) for w in words_of(text)], dtype=np.int64), minlength=dim)
            counts *= weights
            norms = np.linalg.norm(counts, axis=1, keepdims=True)
            unit = (counts / np.where(norms > 0, norms, 1.0)).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * np.int32(dim)), pa.array(unit.ravel()))

    return encode


def embed_with(
    df: DataFrame,
    fn: Callable[[list[str]], Sequence[Sequence[float]] | np.ndarray],
    text_col: str = "text",
    out: str = "vec",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add vectors from the caller's model: ``fn`` maps a list of texts to a matrix."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                matrix = np.asarray(fn(texts.iloc[start : start + batch_size].tolist()), dtype=np.float64)
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                rows.extend((matrix / np.where(norms > 0, norms, 1.0)).astype(np.float32))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return df.withColumn(out, encode(F.col(text_col)))


def with_vectors(
    df: DataFrame, text: Column, embedder: PipelineModel | None = None, fn: Callable | None = None
) -> DataFrame:
    """Add ``vec`` for a text expression, by an embedder or by the caller's model."""
    texts = df.withColumn("text", text)
    if embedder is not None:
        return embed(texts, embedder).drop("text")
    if fn is not None:
        return embed_with(texts, fn).drop("text")
    raise ValueError("texts need an embedder or an embedding function")


def build_vectors(
    incidents: DataFrame,
    embedder: PipelineModel | None = None,
    fn: Callable | None = None,
    dim: int = DIMENSION,
) -> tuple[DataFrame, PipelineModel | None]:
    """The vector table of a set of incidents, and the embedder that made it.

    One row per id. The columns that searches filter on come along, so filtered
    searches need no join.
    """
    require_rows(incidents, 1, "incidents")
    text = embedding_text()
    # The last version of every id is found on narrow rows, so no text that loses is
    # embedded or counted.
    narrow = incidents.select("id", "created_at", F.xxhash64(text).alias("_digest"))
    latest = first_per_key(narrow, ["id"], [F.desc("created_at"), F.asc("_digest")])
    latest = latest.toDF("_id", "_created_at", "_latest")
    texts = incidents.select("id", *VECTOR_FILTER_COLUMNS, text.alias("text"), F.xxhash64(text).alias("_digest"))
    same = (F.col("id") == F.col("_id")) & F.col("created_at").eqNullSafe(F.col("_created_at")) & (F.col("_digest") == F.col("_latest"))
    texts = texts.join(latest, same, "left_semi").drop("_digest")
    if fn is not None:
        vectors, embedder = embed_with(texts, fn).drop("text"), None
    else:
        embedder = embedder or fit_embedder(texts, dim=dim)
        vectors = embed(texts, embedder).drop("text")
    # Only rows alike in id, time and text are left to thin out, by their vectors' narrow columns.
    return first_per_key(vectors, ["id"], [F.asc_nulls_last(c) for c in ("category", "severity")]), embedder
