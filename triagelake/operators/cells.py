"""Exact similarity search that leaves cells of the vector table unread.

Vectors are stored by cell: each belongs to its nearest pivot, cells are folders, and a small
table holds each cell's centre, radius and longest vector. The distance between a query and a centre, with
the radius, bounds every score in the cell (triangle inequality), and so do the lengths
(Cauchy-Schwarz). A query first meets the cells that promise most, which gives it a floor;
then only cells whose bound reaches the floor. Rows are those of `similarity.topk_similar`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from triagelake.operators.blocks import BlockTopK, as_matrix
from triagelake.operators.similarity import shown
from triagelake.session import cut

# Pivots are taken from a sample of so many rows each; more cells mean finer skipping and a larger cell table.
MAX_CELLS = 1024
ROWS_PER_CELL = 2_000
SAMPLE_PER_CELL = 20
ROUNDS = 5

# Cells are cut into slices and the queries of a cell into blocks of so many rows.
SLICE_ROWS = 50_000
BLOCK_ROWS = 4_096
# Single precision loses less than this part of a product of lengths.
ROOM = 1e-6
# Cells that each query meets first.
FIRST_CELLS = 2

CELLS = "cell int, center array<double>, radius double, longest double, rows long"


def write_cells(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Replace ``path`` with the vectors laid out by cell, and the table of cells.

    Pivots are fitted on a bounded sample of the rows, chosen by a hash of their ids; every
    row is indexed. A cell that fills much of the table is cut into slices of files.
    """
    rows = vectors.count()
    wanted = cells or int(min(MAX_CELLS, max(1, rows // ROWS_PER_CELL)))
    pivots = fit_pivots(vectors, rows, wanted)
    columns = vectors.columns
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("_apart", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = as_matrix(batch.column("vec")).astype(np.float64)
            cell, apart = nearest(points, pivots)
            made = {c: batch.column(c) for c in columns}
            yield pa.RecordBatch.from_pydict(made | {"cell": pa.array(cell, pa.int32()), "_apart": pa.array(apart)})

    placed = vectors.mapInArrow(assign, schema)
    laid_out = placed.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "_apart")
    writer = laid_out.write.mode("overwrite")
    # No rows make no folders, and so no table to read.
    (writer.partitionBy("cell") if rows else writer).parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    summary = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("_apart").alias("radius"), F.max(length).alias("longest"), F.count("*").alias("rows"))
    centers = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, center array<double>")
    summary.join(centers, "cell").select("cell", "center", "radius", "longest", "rows").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vectors, cells)`` as `write_cells` laid them out."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.schema(CELLS).parquet(f"{path}/cells")


def fit_pivots(vectors: DataFrame, rows: int, cells: int) -> np.ndarray:
    """Centres of a bounded sample, by a few rounds of k-means; copies count once."""
    part = max(1, rows // (cells * SAMPLE_PER_CELL))
    plain = vectors.select("id", F.col("vec").cast("array<float>").alias("vec"))
    some = plain.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(part)) == 0).limit(2 * cells * SAMPLE_PER_CELL)
    held = as_matrix(some.toArrow()["vec"])
    if not len(held):
        held = as_matrix(plain.limit(1).toArrow()["vec"])
    points = np.unique(held.astype(np.float64), axis=0)
    pivots = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(ROUNDS):
        cell, _ = nearest(points, pivots)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, points)
        n = np.bincount(cell, minlength=len(pivots))
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return np.unique(pivots, axis=0)


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest pivot, distance to it) of every point; the distance is never too small."""
    if not len(points):
        return np.zeros(0, dtype=int), np.zeros(0)
    square = (points**2).sum(axis=1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(axis=1)[None]
    cell = square.argmin(axis=1)
    return cell, np.linalg.norm(points - pivots[cell], axis=1) * (1 + 1e-9) + 1e-12


class CellBounds:
    """The most that a query can score in each cell."""

    def __init__(self, cells: list[T.Row]) -> None:
        self.cell = np.array([c["cell"] for c in cells], dtype=int)
        self.center = np.array([c["center"] for c in cells], dtype=np.float64)
        self.radius = np.array([c["radius"] for c in cells])
        self.longest = np.array([c["longest"] for c in cells])

    def of(self, queries: np.ndarray) -> np.ndarray:
        """q v = q c + q (v - c) <= q c + |q| r, and q v <= |q| |v|; with room for rounding."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        bound = np.minimum(queries @ self.center.T + length * self.radius, length * self.longest)
        return bound + ROOM * (1 + length * (self.longest + self.radius))


def topk_in_cells(
    queries: DataFrame, vectors: DataFrame, cells: DataFrame, k: int = 5, threshold: float = 0.0, exclude_self: bool = False
) -> DataFrame:
    """The rows of `similarity.topk_similar`, from the cells that can hold them."""
    return _searched(queries, vectors, cells, k, threshold, exclude_self)[0]


def pruning(
    queries: DataFrame, vectors: DataFrame, cells: DataFrame, k: int = 5, threshold: float = 0.0, exclude_self: bool = False
) -> DataFrame:
    """One row: queries, vectors, pairs that a full search scores, pairs that this one scores, cells that were read."""
    met = _searched(queries, vectors, cells, k, threshold, exclude_self)[1]
    sizes = cells.agg(F.sum("rows").alias("vectors"))
    scored = met.join(cells, "cell").agg(F.sum("rows").alias("scored"), F.count_distinct("cell").alias("cells_read"))
    n = queries.agg(F.count("*").alias("queries"))
    one = n.join(sizes, F.lit(True)).join(scored, F.lit(True))
    return one.select("queries", "vectors", (F.col("queries") * F.col("vectors")).alias("pairs"), "scored", "cells_read")


def _searched(queries, vectors, cells, k, threshold, exclude_self) -> tuple[DataFrame, DataFrame]:
    """(hits, the cells that each query met)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    # A row per cell, so their number and size are bounded by MAX_CELLS.
    known = cells.collect()
    asked = cut(queries.select("query_id", F.col("vec").cast("array<float>").alias("vec")), "queries")
    promising = cut(_cells_of(asked, known, FIRST_CELLS, None), "first-cells")
    first = cut(_within(asked, promising, vectors, known, k, threshold, exclude_self), "first-hits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("incident_id"))
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = kth.select("query_id", F.greatest("score", F.lit(float(threshold))).alias("floor"))
    held = cut(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(threshold)))), "floors")
    rest = cut(_cells_of(held, known, FIRST_CELLS, "floor"), "other-cells")
    second = _within(held, rest, vectors, known, k, threshold, exclude_self)
    hits = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return hits.withColumn("score", shown(F.col("score"))), promising.unionByName(rest)


def _cells_of(asked: DataFrame, known: list, first: int, floor: str | None) -> DataFrame:
    """(query_id, cell): the ``first`` cells by promise, or all others whose bound reaches the floor."""
    schema = T.StructType([asked.schema["query_id"], T.StructField("cell", T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = CellBounds(known)
        for batch in batches:
            if not batch.num_rows or not known:
                continue
            bound = bounds.of(as_matrix(batch.column("vec")).astype(np.float64))
            place = np.argsort(-bound, axis=1, kind="stable").argsort(axis=1, kind="stable")
            met = place < first
            if floor is not None:
                met = ~met & (bound >= batch.column(floor).to_numpy()[:, None])
            q, c = np.nonzero(met)
            yield pa.RecordBatch.from_pydict(
                {"query_id": batch.column("query_id").take(pa.array(q)), "cell": pa.array(bounds.cell[c], pa.int32())}
            )

    return asked.mapInArrow(choose, schema)


def _within(asked: DataFrame, met: DataFrame, vectors: DataFrame, known: list, k: int, threshold: float, exclude_self: bool) -> DataFrame:
    """The best rows of each slice of a cell for the queries that meet it.

    Only cells that are met are read. A cell's slices and its queries' blocks are groups of
    bounded size, however large the cell and however many queries meet it.
    """
    needed = [r["cell"] for r in met.select("cell").distinct().collect()]  # at most MAX_CELLS
    slices = {c["cell"]: -(-c["rows"] // SLICE_ROWS) for c in known if c["cell"] in set(needed)}
    spark = asked.sparkSession
    sizes = spark.createDataFrame([(c, s) for c, s in slices.items()], "cell int, slices int")
    blocks = met.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = sizes.join(F.broadcast(blocks), "cell")  # a row per cell
    own = asked.columns
    pairs = met.join(F.broadcast(sizes), "cell").join(asked, "query_id")
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = pairs.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *own)
    held = vectors.where(F.col("cell").isin(needed)).select("cell", "id", F.col("vec").cast("array<float>").alias("vec"))
    held = held.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id", F.lit(2)), F.col("slices")).cast("int"))
    held = held.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "slice", "id", "vec")
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("incident_id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("_k", T.IntegerType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def search(key: tuple[pa.Scalar, ...], block: pa.Table, rows: pa.Table) -> pa.Table:
        if not block.num_rows or not rows.num_rows:
            return arrow_schema.empty_table()
        n = block.num_rows
        floor = block["floor"].to_numpy() if "floor" in block.column_names else np.full(n, float(threshold))
        best = BlockTopK(block["query_id"].combine_chunks(), as_matrix(block["vec"]), np.full(n, k), floor, exclude_self)
        for part in rows.to_batches(max_chunksize=8_192):
            best.add(part.column("id"), as_matrix(part.column("vec")))
        return best.result(arrow_schema)

    keys = ("cell", "slice", "block")
    return pairs.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, schema).drop("_k")
