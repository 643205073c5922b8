"""Saved classifiers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from triagelake.operators.classifier import feature_names, model_categories


def save_model(model: PipelineModel | None, path: str) -> None:
    """Write the model, and next to it its categories and first feature names."""
    if model is None:
        raise ValueError("no model to save")
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame(
        [(model_categories(model), feature_names(model))], "categories array<string>, feature_names array<string>"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def model_metadata(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(f"{path}/metadata").first()
    return row.asDict()
