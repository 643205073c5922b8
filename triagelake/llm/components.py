"""Connected components of a table of links, by alternating star contractions.

Each round hangs the larger neighbours of every node on its smallest neighbour, then does
the same with the smaller ones. Both steps are a grouped minimum, combined before the
shuffle, and a join back that Spark may split where a node has many links. Rounds are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.session import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_low")).select(F.col("u").alias("_u"), F.least("u", "_low").alias("low"))
    low = cut(low, "lowest")  # grouped: written, so that a crowded node can be split in the join
    return both.where("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    low = cut(low, "lowest")
    moved = down.join(low.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where("v <> low")
    return moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v); the component is its smallest node.

    Links may repeat, point either way or from a node to itself; rows with a null are
    dropped. Nodes of a single link to themselves are not returned. No link, no row.
    """
    edges = cut(links.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        edges = cut(_small_star(_large_star(edges)).distinct(), "links")
        # Rounds keep what is connected. Once no smallest neighbour hangs on another node,
        # the links are stars, and each star is a component.
        ends = edges.select(F.col("u").alias("_u"))
        if edges.join(ends, F.col("v") == F.col("_u"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    low = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct())
