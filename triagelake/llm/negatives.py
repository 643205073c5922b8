"""Hard negatives: rows of other labels that score a little below an anchor's positives.

Cover trees over norm-augmented candidates. One more component lifts every candidate of a
shard to the same norm, so the inner product with a query falls as the distance grows. A
tree covers its shard level by level with balls of shrinking radius; the distance to a
ball's centre and its radius bound the scores of all rows inside from both sides. The best ball
is opened first; balls that lie outside every window that is still open are skipped
unseen, and the rows of a leaf are scored exactly.

Shards are small groups of rows, anchors come in blocks, and a task holds one block and
one tree at a time. Every anchor has to meet every shard that it may have rows in, as the
search is exact; blocks and shards are dealt out by Spark.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut

POSITIVES = 5
NEGATIVES = 3
# A negative's score is between these shares of the positive's, in hundredths.
LOW, HIGH = 50, 95
SCALE = 256

SHARD_ROWS = 4096
# Labels with fewer rows than such a part of a shard share shards.
SMALL_PART = 8
BLOCK_ROWS = 1024
LEAF_ROWS = 64
SHRINK = 1.3
# Balls opened at a time, at first and at most.
FIRST_BALLS, MOST_BALLS = 8, 256
# Scores up to here are whole numbers in double precision.
EXACT = float(1 << 53)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has id (whole numbers), label and vec; rows where ``anchor`` holds are the
    queries. Components become floor(scale * x), scores are whole inner products; higher
    scores come first, then smaller ids. For every anchor and each of its first
    ``positives`` other rows of the same label come the first ``negatives`` rows of other
    labels whose score is between ``low`` and ``high`` hundredths of the positive's.

    Rows with a null id, label, vector or component, or one that is not finite, take no part,
    nor do vectors whose squared length reaches 2^53 (their scores would not be exact).
    Of rows that share an id the one with the smallest label, then vector, stays. Vectors of
    different length never meet. Other columns are not looked at. No rows give no rows.
    """
    rows = _scaled(vectors.select("id", "label", "vec", F.coalesce(anchor, F.lit(False)).alias("anchor")), scale)
    placed = _placed(rows)
    trees = cut(_trees(placed), "trees")
    anchors = cut(placed.where("anchor"), "anchors")
    first = _against_own(anchors, trees, positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = cut(first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= positives), "positives")
    wanted = best.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("windows"))
    asked = anchors.join(wanted.withColumnRenamed("anchor_id", "id"), "id")
    found = _against_others(cut(asked, "asked"), trees, negatives, low, high)
    pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(pair)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """id, label, v (whole components), dim, anchor; one row per id."""
    wide = F.transform("vec", lambda x: F.lit(scale) * x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    given = vectors.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad)
    length = F.aggregate(wide, F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) + 1, 2))
    usable = given.where(length < EXACT)
    rows = usable.select(
        F.col("id").cast("long").alias("id"),
        F.struct(F.col("label").cast("string").alias("label"), F.transform(wide, lambda x: F.floor(x).cast("int")).alias("v"), "anchor").alias("row"),
    )
    one = rows.groupBy("id").agg(F.min("row").alias("row"))
    return cut(one.select("id", "row.*", F.size("row.v").alias("dim")), "vectors")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their family and shard.

    A family is a label, dealt out by id if it has more rows than a shard holds, or a pool of
    small labels. Shards are numbered through, ``shards`` is their number; all per vector length.
    The running sum that numbers them is over one row per family.
    """
    labels = cut(rows.groupBy("dim", "label").agg(F.count("*").alias("n")), "labels")
    large = F.col("n") > SHARD_ROWS // SMALL_PART
    pools = labels.groupBy("dim").agg(F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / SHARD_ROWS).alias("_pools"))
    labels = labels.join(pools, "dim").select(
        "dim",
        "label",
        F.when(large, F.concat(F.lit("="), "label"))
        .otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("label"), F.greatest("_pools", F.lit(1))).cast("string")))
        .alias("family"),
        F.when(large, F.ceil(F.col("n") / SHARD_ROWS)).otherwise(1).cast("long").alias("slices"),
    )
    order = Window.partitionBy("dim").orderBy("family")
    families = labels.select("dim", "family", "slices").distinct()
    families = families.withColumns(
        {
            "offset": F.coalesce(F.sum("slices").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "shards": F.sum("slices").over(Window.partitionBy("dim")),
        }
    )
    places = cut(labels.join(families.drop("slices"), ["dim", "family"]), "places")
    placed = rows.join(places, ["dim", "label"])
    return placed.withColumn("shard", F.col("offset") + F.pmod(F.xxhash64("id"), F.col("slices")))


TREE = "dim int, shard long, family string, tree binary"


def _trees(placed: DataFrame) -> DataFrame:
    """One row per shard: its rows as a cover tree."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        tree = CoverTree.of(ids, rows["label"].to_pylist(), matrix(rows["v"], key[0].as_py()))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": [key[1].as_py()], "family": rows["family"][:1], "tree": pa.array([tree.packed()], pa.binary())})

    return placed.select("dim", "shard", "family", "id", "label", "v").groupBy("dim", "shard").applyInArrow(build, TREE)


def _against_own(anchors: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of the same label in each shard that may hold some."""
    sizes = cut(anchors.groupBy("dim", "family").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "blocks")
    blocked = anchors.join(sizes, ["dim", "family"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    asked = blocked.select("dim", F.explode(F.sequence("offset", F.col("offset") + F.col("slices") - 1)).alias("shard"), "block", "id", "label", "v")
    held = trees.join(sizes, ["dim", "family"]).select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tree")

    def search(key: tuple[pa.Scalar, ...], block: pa.Table, tree: pa.Table) -> pa.Table:
        if not block.num_rows or not tree.num_rows:
            return pa.schema([(c, pa.int64()) for c in ("anchor_id", "id", "score")]).empty_table()
        n = block.num_rows
        windows = Windows(np.arange(n), np.full(n, -EXACT), np.full(n, EXACT), k, same_label=True)
        at, ids, scores = searched(CoverTree.unpacked(tree["tree"][0].as_py()), block, key[0].as_py(), windows)
        return pa.table({"anchor_id": block["id"].to_numpy()[at], "id": ids, "score": scores})

    pairs = asked.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block"))
    return pairs.applyInArrow(search, "anchor_id long, id long, score long")


def _against_others(asked: DataFrame, trees: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The first ``k`` rows of other labels inside every window, in each shard that may hold some."""
    sizes = cut(asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "blocks")
    blocked = asked.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    # Shards of the anchor's own family hold no other label, unless it is a pool.
    own = F.col("family").startswith("=") & F.col("shard").between(F.col("offset"), F.col("offset") + F.col("slices") - 1)
    every = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).where(~own)
    every = every.select("dim", "shard", "block", "id", "label", "v", "windows")
    held = trees.join(sizes, "dim").select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tree")
    names = ("anchor_id", "positive_id", "positive_score", "id", "score")

    def search(key: tuple[pa.Scalar, ...], block: pa.Table, tree: pa.Table) -> pa.Table:
        if not block.num_rows or not tree.num_rows:
            return pa.schema([(c, pa.int64()) for c in names]).empty_table()
        lists = block["windows"].combine_chunks()
        query = lists.value_parent_indices().to_numpy()
        flat = lists.flatten()
        positive, score = flat.field("positive_id").to_numpy(), flat.field("positive_score").to_numpy()
        # low * p <= 100 * n <= high * p, in whole numbers
        windows = Windows(query, -((-low * score) // 100), (high * score) // 100, k, same_label=False)
        at, ids, scores = searched(CoverTree.unpacked(tree["tree"][0].as_py()), block, key[0].as_py(), windows)
        anchor = block["id"].to_numpy()[query[at]]
        return pa.table(dict(zip(names, (anchor, positive[at], score[at], ids, scores), strict=True)))

    pairs = every.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block"))
    return pairs.applyInArrow(search, ", ".join(f"{c} long" for c in names))


def matrix(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of whole numbers in double precision, which holds them exactly."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(lists), dim)


class CoverTree:
    """A cover tree with its rows in the order of its leaves, so a node is a slice of rows.

    Nodes are in arrays: slice, row of the centre, covering radius, first and last child
    (none for a leaf). A node's own centre is the first of its children's.
    """

    def __init__(self, ids, codes, names, rows, top, nodes) -> None:
        self.ids, self.codes, self.names, self.rows, self.top = ids, codes, names, rows, top
        self.start, self.stop, self.center, self.radius, self.first, self.last = nodes

    @classmethod
    def of(cls, ids: np.ndarray, labels: list[str], rows: np.ndarray) -> CoverTree:
        names, codes = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        ids, codes, rows = ids[order], codes[order], rows[order]
        lengths = np.einsum("ij,ij->i", rows, rows)
        top = float(lengths.max())
        points = np.column_stack([rows, np.sqrt(top - lengths)])
        order, nodes = grow(points)
        return cls(ids[order], codes[order], names, rows[order], top, nodes)

    def packed(self) -> bytes:
        file = io.BytesIO()
        nodes = [self.start, self.stop, self.center, self.radius, self.first, self.last]
        np.savez(file, ids=self.ids, codes=self.codes.astype(np.int32), names=self.names.astype("U"), rows=self.rows.astype(np.int32), top=self.top, nodes=np.array(nodes))
        return file.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        nodes = [x.astype(float) if i == 3 else x.astype(int) for i, x in enumerate(held["nodes"])]
        return cls(held["ids"], held["codes"], held["names"], held["rows"].astype(np.float64), float(held["top"]), nodes)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row below each node can have, with room for rounding."""
        both = np.einsum("ij,ij->i", queries, queries)[:, None] + self.top
        apart = np.sqrt(np.maximum(both - 2 * (queries @ self.rows[self.center[nodes]].T), 0))
        room = 1 + 1e-9 * both
        radius = self.radius[nodes]
        return (both - (apart + radius) ** 2) / 2 - room, (both - np.maximum(apart - radius, 0) ** 2) / 2 + room


def grow(points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order of rows, node arrays): balls that shrink by ``SHRINK`` from level to level."""
    order = np.arange(len(points))
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, at: int) -> int:
        """A node over ``rows``, which begin with its centre and stand from ``at`` on."""
        order[at : at + len(rows)] = rows
        far = points[rows] - points[rows[0]]
        radius = float(np.sqrt(np.einsum("ij,ij->i", far, far).max()))
        nodes.append([at, at + len(rows), at, radius * (1 + 1e-9), -1, -1])
        return len(nodes) - 1

    waiting = [(add(order.copy(), 0), None)]
    while waiting:
        node, scale = waiting.pop()
        start, stop, _, radius, _, _ = nodes[node]
        if stop - start <= LEAF_ROWS or radius == 0:
            continue
        scale = min(radius, scale or radius) / SHRINK
        rows = order[int(start) : int(stop)].copy()
        at, first = int(start), len(nodes)
        made = []
        while len(rows):
            far = points[rows] - points[rows[0]]
            near = np.einsum("ij,ij->i", far, far) <= scale * scale
            near[0] = True
            made.append(add(rows[near], at))
            at += int(near.sum())
            rows = rows[~near]
        # Children are built before their own children, so they stand together.
        nodes[node][4:] = [first, first + len(made)]
        waiting += [(child, scale) for child in made]
    return order, [np.array(column) for column in zip(*nodes, strict=True)]


class Windows:
    """For each window, a query's range of scores, the best ``k`` rows found so far. Windows come query by query."""

    def __init__(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> None:
        self.query, self.low, self.high, self.k, self.same_label = query, low.astype(float), high.astype(float), k, same_label
        self.least = self.low.copy()
        self.first = np.searchsorted(query, np.arange(query[-1] + 1))
        self.many = np.diff(np.append(self.first, len(query)))
        self.window = np.zeros(0, dtype=int)
        self.ids = np.zeros(0, dtype=np.int64)
        self.scores = np.zeros(0)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Per query, the range of scores that can still add to one of its windows."""
        return np.minimum.reduceat(self.least, self.first), np.maximum.reduceat(self.high, self.first)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows by query: each goes to all windows of the query that it fits in."""
        many = self.many[queries]
        hit = np.repeat(np.arange(len(queries)), many)
        window = self.first[queries][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
        fits = (scores[hit] >= self.least[window]) & (scores[hit] <= self.high[window])
        window, hit = window[fits], hit[fits]
        window = np.concatenate([self.window, window])
        ids, scores = np.concatenate([self.ids, ids[hit]]), np.concatenate([self.scores, scores[hit]])
        order = np.lexsort((ids, -scores, window))
        window, ids, scores = window[order], ids[order], scores[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        full = rank == self.k - 1
        self.least[window[full]] = scores[full]
        keep = rank < self.k
        self.window, self.ids, self.scores = window[keep], ids[keep], scores[keep]


def searched(tree: CoverTree, block: pa.Table, dim: int, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, id, score) of the best rows of the tree, by best-first descent for the whole block.

    The best balls are opened several at a time, few at first, more once the windows have filled.
    """
    queries = matrix(block["v"], dim)
    own = block["id"].to_numpy()
    names = {name: code for code, name in enumerate(tree.names.tolist())}
    codes = np.array([names.get(x, -1) for x in block["label"].to_pylist()])

    def still(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(open or not by query and node, greatest score of each node over open queries)."""
        below, above = tree.bounds(queries, nodes)
        least, most = windows.ranges()
        wanted = (above >= least[:, None]) & (below <= most[:, None])
        return wanted, np.where(wanted, above, -np.inf).max(axis=0)

    waiting: list[tuple[float, int]] = [(0.0, 0)]
    together = FIRST_BALLS
    while waiting:
        nodes = np.array([heappop(waiting)[1] for _ in range(min(together, len(waiting)))])
        together = min(2 * together, MOST_BALLS)
        wanted, _ = still(nodes)
        kept = wanted.any(axis=0)
        nodes, wanted = nodes[kept], wanted[:, kept]
        inner = tree.first[nodes] >= 0
        if inner.any():
            children = np.concatenate([np.arange(tree.first[n], tree.last[n]) for n in nodes[inner]])
            opened, best = still(children)
            for child in np.nonzero(opened.any(axis=0))[0]:
                heappush(waiting, (-best[child], int(children[child])))
        leaves = nodes[~inner]
        if len(leaves):
            rows = np.concatenate([np.arange(tree.start[n], tree.stop[n]) for n in leaves])
            asked = np.nonzero(wanted[:, ~inner].any(axis=1))[0]
            scores = queries[asked] @ tree.rows[rows].T
            least, most = windows.ranges()
            inside = (scores >= least[asked][:, None]) & (scores <= most[asked][:, None])
            inside &= (codes[asked][:, None] == tree.codes[rows][None]) == windows.same_label
            q, r = np.nonzero(inside)
            other = own[asked[q]] != tree.ids[rows[r]]
            q, r = q[other], r[other]
            windows.add(asked[q], tree.ids[rows[r]], scores[q, r])
    return windows.window, windows.ids, windows.scores.astype(np.int64)
