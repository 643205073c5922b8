"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source first gives whole epochs of its documents; what its target still lacks is
drawn without replacement. A document's key is an exponential variable divided by its
quality weight; the documents with the smallest keys are taken until their words, summed
in that order, reach the rest of the target.

No source is sorted whole. Keys fall into as many slices as the square root of the
source's documents; sums per slice tell in which slice the budget ends, and only that
slice is sorted, so a source that holds a third of all rows is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelake.llm.quality import n_symbols
from triagelake.llm.words import apart, spaced_words
from triagelake.session import cut

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))).cast("string")
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def quality_weight(size: Column, symbols: Column) -> Column:
    """Words among words and symbols, at least 0.05: noisy documents are drawn less often."""
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(size.cast("double"), size + symbols), F.lit(1.0)))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Id, source, size and key of every row, without the text."""
    counted = docs.select(
        "doc_id",
        "source",
        F.size(spaced_words(F.col("text"))).cast("long").alias("size"),
        n_symbols(F.col("text")).alias("symbols"),
    )
    weight = quality_weight(F.col("size"), F.col("symbols"))
    return counted.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"))


def source_targets(
    sources: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = TOTAL_SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Targets of ``sources`` (source, source_size, n_docs), one row per source.

    Weights go round the sources in code point order, null last. A target is at most
    ``max_epochs`` times its source; what that leaves over is shared among the others by
    weight, again until no target is above: all the others then stand at one level of
    target per weight, which one pass over the sources in the order of limit per weight finds.
    The windows hold one row per source, not per document.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ring = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.get(ring, (F.row_number().over(by_name) - 1) % len(weights)))
    weighed = weighed.withColumn("limit", F.lit(float(max_epochs)) * F.col("source_size")).withColumn(
        "ratio", F.col("limit") / F.col("weight")
    )
    before = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level)
    reached = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.withColumn("reached", reached).select(
        "source",
        "source_size",
        "n_docs",
        F.coalesce(F.least(F.col("limit"), F.col("reached") * F.col("weight")), F.col("limit")).alias("target"),
    )


def mix_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """How often each document is taken.

    Returns doc_id, source, size, source_size, target (of the source), copies and taken
    (words with repeats), one row per input row. The document on which the budget ends is
    taken if its middle lies within the budget, so a source misses its target by half a
    document at most. A null source is a source of its own; a document without words has
    size 0 and takes no part in the draw. Equal keys (repeated ids) are ordered by id and
    size. An empty table gives no rows.
    """
    rows = cut(sized(docs, seed), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sources).select(
        F.col("source").alias("_source"),
        "source_size",
        "n_docs",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .cast("long")
        .alias("epochs"),
    )
    targets = cut(
        targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets"
    )
    last = F.ceil(F.sqrt(F.col("n_docs")))
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "slice", F.floor(last * (1 - F.exp(-F.col("key"))))
    )

    sums = placed.groupBy("_source", "rest", "slice").agg(F.sum("size").alias("slice_size"))
    so_far = W.partitionBy("_source").orderBy("slice")
    ends = (
        sums.withColumn("end", F.sum("slice_size").over(so_far))
        .where(F.col("end") >= F.col("rest"))
        .groupBy("_source")
        .agg(F.min(F.struct("slice", (F.col("end") - F.col("slice_size")).alias("start"))).alias("cut"))
        .select(F.col("_source").alias("_end_source"), F.col("cut.slice").alias("end_slice"), F.col("cut.start").alias("start"))
    )
    ends = cut(ends, "mix-ends")
    marked = placed.join(ends, F.col("_source").eqNullSafe(F.col("_end_source")), "left")
    kept = ("doc_id", "source", "size", "source_size", "target", "epochs")
    inside = marked.where(F.col("slice") == F.col("end_slice"))
    order = W.partitionBy("_source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    sorted_out = inside.withColumn("drawn", middle <= F.col("rest")).select(*kept, "drawn")
    clear = marked.where(~F.col("slice").eqNullSafe(F.col("end_slice")))
    clear = clear.withColumn("drawn", F.coalesce(F.col("slice") < F.col("end_slice"), F.lit(True))).select(*kept, "drawn")
    copies = F.col("epochs") + (F.col("drawn") & (F.col("size") > 0)).cast("long")
    return (
        clear.unionByName(sorted_out)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("epochs", "drawn")
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: the rows of ``docs``, once per copy, with ``epoch`` counted from 1.

    Rows that share an id share the decision of the id's first size, so repeated rows are
    each taken as often. Documents without words are left out. A column ``epoch`` is replaced.
    """
    taken = (
        mix_sizes(docs, seed)
        .where(F.col("taken") > 0)
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_size"))
        .agg(F.max("copies").alias("_copies"))
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id"))
        & F.col("source").eqNullSafe(F.col("_from"))
        & (F.size(spaced_words(F.col("text"))) == F.col("_size"))
    )
    packed, back = apart(docs.drop("epoch"), ("doc_id", "source", "text"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return back(packed.join(taken, same).withColumn("epoch", copies), "epoch")
