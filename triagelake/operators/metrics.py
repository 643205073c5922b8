"""Classification metrics from ``(id, actual, predicted)`` rows.

Everything starts from the counts per (actual, predicted) pair: a few dozen rows
however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.ranking import top_n_per_key
from triagelake.schema import KNOWN_CATEGORIES


def pair_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: Sequence[str] = KNOWN_CATEGORIES) -> DataFrame:
    """Long form ``(actual, predicted, n)`` with a row for every pair of classes."""
    spark = predictions.sparkSession
    names = F.array(*[F.lit(c) for c in classes])
    grid = spark.range(1).select(F.explode(names).alias("actual")).select(
        "actual", F.explode(names).alias("predicted")
    )
    counted = pair_counts(predictions)
    return grid.join(counted, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_matrix_wide(
    predictions: DataFrame, classes: Sequence[str] = KNOWN_CATEGORIES
) -> DataFrame:
    """One row per actual class, one column per predicted class, in class order."""
    cells = confusion_matrix(predictions, classes)
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("actual"))
    return (
        cells.groupBy("actual")
        .pivot("predicted", list(classes))
        .agg(F.sum("n"))
        .orderBy(order)
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    A ratio with nothing below the line is 0.
    """
    pairs = pair_counts(predictions)
    correct = F.col("actual") == F.col("predicted")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
    )
    hit = F.when(correct, F.col("n")).otherwise(0)
    per_class = (
        pairs.select(F.explode(sides).alias("s"), hit.alias("hit"))
        .groupBy("s.label")
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.claimed").alias("claimed"),
            (F.sum("hit") / 2).alias("hits"),  # counted on both sides
        )
        .select(
            "label",
            _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
            _ratio(F.col("hits"), F.col("support")).alias("recall"),
            _ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1_score"),
            "support",
            "hits",
        )
    )
    scores = ["precision", "recall", "f1_score"]
    total = F.sum("support")
    none = F.lit(None).cast("double")
    averages = per_class.agg(
        F.struct(
            F.lit("accuracy").alias("label"),
            none.alias("precision"),
            none.alias("recall"),
            _ratio(F.sum("hits"), total).alias("f1_score"),
            total.alias("support"),
        ).alias("a"),
        F.struct(
            F.lit("macro avg").alias("label"),
            *[F.avg(s).alias(s) for s in scores],
            total.alias("support"),
        ).alias("m"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
            total.alias("support"),
        ).alias("w"),
    ).select(F.explode(F.array("a", "m", "w")).alias("row")).select("row.*")
    return per_class.drop("hits").unionByName(averages)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row ``(labelled, correct, accuracy)``; 0 when there is nothing to score."""
    return predictions.agg(
        F.count(F.lit(1)).alias("labelled"),
        F.count_if(F.col("actual") == F.col("predicted")).alias("correct"),
    ).withColumn("accuracy", _ratio(F.col("correct"), F.col("labelled")))


def top_confusions(predictions: DataFrame, n: int = 5) -> DataFrame:
    """The commonest mistakes."""
    return (
        pair_counts(predictions)
        .filter(F.col("actual") != F.col("predicted"))
        .orderBy(F.desc("n"), "actual", "predicted")
        .limit(n)
    )


def sample_predictions(predictions: DataFrame, sample: int = 10) -> DataFrame:
    """Half of the sample wrong predictions, half right ones, first ids first."""
    marked = predictions.withColumn("correct", F.col("actual") == F.col("predicted"))
    return top_n_per_key(marked, ["correct"], [F.asc("id")], sample // 2)
