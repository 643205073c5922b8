"""Category and severity of incidents, by rule or by model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.rules import category_of, severity_of
from triagelake.functions.text import query_text
from triagelake.operators.classifier import predict


def classify(df: DataFrame, model: PipelineModel | None = None, engine: str = "scan") -> DataFrame:
    """Add predicted_category, category_confidence and predicted_severity.

    A trained model decides the category if there is one, the keyword rule
    otherwise. Works on streams too.
    """
    lowered = df.withColumn("_lowered", F.lower(query_text()))  # one lower-case copy for all rules
    if model is not None:
        judged = (
            predict(model, lowered)
            .withColumnRenamed("predicted", "predicted_category")
            .withColumnRenamed("confidence", "category_confidence")
        )
    else:
        judged = (
            lowered.withColumn("_rule", category_of(F.col("_lowered"), engine))
            .withColumn("predicted_category", F.col("_rule.category"))
            .withColumn("category_confidence", F.col("_rule.confidence"))
            .drop("_rule")
        )
    return judged.withColumn("predicted_severity", severity_of(F.col("_lowered"))).drop("_lowered")
