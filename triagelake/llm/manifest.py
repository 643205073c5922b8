"""Merkle manifest of a table: a digest for every row, trees over them, proofs and their verification.

Time-forward processing. Nodes are labelled (level, place). A sweep visits them in the order of
labels, and a priority queue ordered by label carries each digest to the parent that waits
for it. The sweep back visits them in reverse, and the queue carries to each child what
stands beside the path above it, until the leaves have their proofs. The queue is external:
between blocks of ``BLOCK`` consecutive nodes it is Spark's shuffle, which may spill; inside a
block, which is one small group, it is a heap. A tree of n rows takes log n / log BLOCK rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut

LEVELS = 12
BLOCK = 1 << LEVELS

# The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Where the other node of a run of two stands, if there is one.
LEFT, RIGHT, ALONE = "<", ">", "-"
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value with its number of UTF-8 bytes before it, ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def merkle_manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    changed: Mapping[str, Column] | None = None,
    with_proofs: bool = False,
) -> DataFrame:
    """Per row: its key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows of a group, in the order of their keys, are the leaves of a tree; the roots of
    the groups, in the order of the groups' names in UTF-8 bytes, are the leaves of the
    tree that gives ``root``. Two consecutive nodes have a parent, one left over has a parent of
    its own; a lone leaf is its own root. ``changed`` names other values for some fields:
    each row is then verified as if it held those, against the proof of the row as it was.
    ``with_proofs`` adds ``proof``, the digests beside the path, and ``sides``, one character a level.

    A null is hashed as ``-``, so it differs from an empty text. Rows without a key come
    first, rows without a group are the first group. Rows that share a key are ordered by
    their digests; equal rows are leaves of their own. Columns that are not in ``fields``
    play no part, whatever their names. No rows give no rows. Texts are hashed whole, inside
    Spark; only digests move.
    """
    changed = changed or {}
    field = {f: F.col(f"`{f}`") for f in fields}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("_group"),
        F.col(f"`{key}`").alias("_key"),
        row_digest(list(field.values())).alias("digest"),
        row_digest([changed.get(f, c) for f, c in field.items()]).alias("seen"),
    )
    # Written before they are ordered: a sort by range reads its input twice.
    layers = _swept_up(_placed(cut(leaves, "digests")))
    subroots = cut(_roots(layers), "subroots")
    names = subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_key"), "digest")
    upper = _swept_up(_placed(names))
    root = _roots(upper).first()
    start = upper[0].select("_group").distinct().withColumns({"proof": F.lit(""), "sides": F.lit("")})
    tops = cut(_swept_down(upper, start).select(F.col("_key").alias("_group"), "proof", "sides"), "tops")
    proved = _swept_down(layers, tops).join(subroots.select("_group", F.col("digest").alias("subroot")), "_group")
    shown = proved.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "seen", "subroot", "proof", "sides")
    checked = shown.withColumns({"proof_sha256": F.sha2("proof", 256), "folded_root": F.lit(None).cast("string")})
    checked = checked.mapInArrow(_folded, checked.schema)
    return checked.select(
        key,
        "leaf",
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.lit(root["digest"] if root else None)).alias("verified"),
        *(["proof", "sides"] if with_proofs else []),
    )


def _placed(leaves: DataFrame) -> DataFrame:
    """Leaves with ``pos``, their place in their group, and ``n``, the group's size.

    Ordered by range over all groups, so that a large group is dealt out too; a slice
    counts its rows, and a running sum over slices gives what stands before each.
    """
    ordered = leaves.repartitionByRange("_group", "_key", "digest").sortWithinPartitions("_group", "_key", "digest")
    ordered = cut(ordered.withColumns({"_slice": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "leaves")
    slices = ordered.groupBy("_group", "_slice").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_group",
        "_slice",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"),
    )
    placed = ordered.join(cut(slices, "slices"), ["_group", "_slice"])
    return placed.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_slice", "_row", "_shift")


def _swept_up(leaves: DataFrame) -> list[DataFrame]:
    """The leaves, and each layer of block roots above them, up to where every group has one node."""
    layers = [cut(leaves, "layer")]
    largest = layers[0].agg(F.max("n")).first()[0] or 0
    while largest > 1:
        layers.append(cut(_in_blocks(layers[-1]).applyInArrow(_block_root, "_group string, n long, pos long, digest string"), "layer"))
        largest = -(-largest // BLOCK)
    return layers


def _in_blocks(layer: DataFrame):
    nodes = layer.where("n > 1").select("_group", "n", "pos", "digest")
    return nodes.withColumn("_block", F.shiftright("pos", LEVELS)).groupBy("_group", "_block")


def _roots(layers: list[DataFrame]) -> DataFrame:
    """(_group, digest): the one node that each group comes to."""
    out = layers[0].where("n = 1").select("_group", "digest")
    for layer in layers[1:]:
        out = out.unionByName(layer.where("n = 1").select("_group", "digest"))
    return out


def _swept_down(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with their proofs; ``tops`` has what stands beside the path above each group's root."""
    known: DataFrame | None = None
    for layer in reversed(layers):
        here = layer.where("n = 1").join(tops, "_group")
        if known is not None:
            names = [f for f in layer.schema.fields if f.name not in ("_group", "n", "pos", "digest")]
            nodes = layer.where("n > 1").withColumn("_block", F.shiftright("pos", LEVELS))
            schema = here.schema
            above = known.select("_group", F.col("pos").alias("_block"), "proof", "sides")
            below = nodes.groupBy("_group", "_block").cogroup(above.groupBy("_group", "_block"))
            extra = [f.name for f in names]
            columns = [f.name for f in schema.fields]
            here = here.unionByName(below.applyInArrow(_block_proofs(columns, extra), schema))
        known = cut(here.select("_group", "pos", "proof", "sides"), "proofs") if layer is not layers[0] else here
    return known


def heights(n: int) -> int:
    """Levels of a block in a group of ``n`` nodes."""
    return LEVELS if n > BLOCK else (n - 1).bit_length()


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of all levels of a block, its leaves first."""
    found: list[list[str]] = [digests, *([] for _ in range(levels))]
    queue = [(1, i // 2, i, d) for i, d in enumerate(digests)]
    heapify(queue)
    while queue[0][0] <= levels:
        level, place, _, received = heappop(queue)
        while queue and queue[0][:2] == (level, place):
            received += heappop(queue)[3]
        mine = digest(received)
        found[level].append(mine)
        heappush(queue, (level + 1, place // 2, place, mine))
    return found


def sweep_down(found: list[list[str]], proof: str, sides: str) -> list[tuple[str, str]]:
    """(proof, sides) of every leaf of a block, given those of its root."""
    leaves: list[tuple[str, str]] = [("", "")] * len(found[0])
    queue = [(1 - len(found), 0, proof, sides)]
    while queue:
        level, place, proof, sides = heappop(queue)
        if level == 0:
            leaves[-place] = (proof, sides)
            continue
        below = found[-level - 1]
        for child in (-2 * place, -2 * place + 1):
            beside = child ^ 1
            if child < len(below) and beside < len(below):
                heappush(queue, (level + 1, -child, below[beside] + proof, (LEFT if child % 2 else RIGHT) + sides))
            elif child < len(below):
                heappush(queue, (level + 1, -child, proof, ALONE + sides))
    return leaves


def fold(leaf: str, proof: str, sides: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for side in sides:
        if side == ALONE:
            leaf = digest(leaf)
            continue
        beside = proof[at : at + HEX]
        at += HEX
        leaf = digest(beside + leaf if side == LEFT else leaf + beside)
    return leaf


def _block_root(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    n = rows["n"][0].as_py()
    top = sweep_up(rows["digest"].to_pylist(), heights(n))[-1]
    return pa.table({"_group": [key[0].as_py()], "n": [-(-n // BLOCK)], "pos": [key[1].as_py()], "digest": top})


def _block_proofs(columns: list[str], extra: list[str]):
    def proofs(key: tuple[pa.Scalar, ...], rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        found = sweep_up(rows["digest"].to_pylist(), heights(rows["n"][0].as_py()))
        leaves = sweep_down(found, above["proof"][0].as_py(), above["sides"][0].as_py())
        made = {"proof": pa.array([p for p, _ in leaves]), "sides": pa.array([s for _, s in leaves])}
        held = {c: rows[c] for c in ("_group", "n", "pos", "digest", *extra)}
        return pa.table({c: (held | made)[c] for c in columns})

    return proofs


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("seen", "proof", "sides")]
        roots = pa.array([fold(*row) for row in zip(*columns, strict=True)], pa.string())
        at = batch.schema.get_field_index("folded_root")
        yield batch.set_column(at, batch.schema.field(at), roots)
