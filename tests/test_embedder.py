"""The built-in embedder in one step against its pipeline of stages."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from triagelake.operators import embedding

TEXTS = ["Database CPU is high, cpu is HIGH", "", "a b c", "straße ÉTÉ été_2 x1 1x", "naïve ‘quotes’ 中文字符 текст", "word " * 500, "cpu cpu cpu", "ⅷ ½½ 日本", "I-II-III"]


def test_one_step_equals_the_stages(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").repartition(3)
    model = embedding.fit_embedder(df, dim=32)
    quick = {r["id"]: r["vec"] for r in embedding.embed(df, model).collect()}
    chain = {r["id"]: r["u"] for r in model.transform(df).select("id", F.unwrap_udt("_unit").alias("s"), embedding.vector_to_array("_unit", "float32").alias("u")).collect()}
    for i in range(len(TEXTS)):
        assert np.allclose(quick[i], chain[i], atol=1e-7), TEXTS[i]
        assert abs(np.linalg.norm(quick[i]) - 1) < 1e-6 or not any(quick[i])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert {r["id"]: r["vec"] for r in embedding.embed(df, again).collect()} == quick
    assert embedding.built_in_weights(again) is not None and embedding.built_in_weights(PipelineModel(again.stages[:3])) is None


def test_weights_are_those_of_the_fitted_stage(spark):
    from pyspark.ml.feature import IDF

    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(4)
    model = embedding.fit_embedder(df, dim=16)
    counted = PipelineModel(model.stages[:3]).transform(df)
    wanted = IDF(inputCol="_tf", outputCol="x").fit(counted).idf.toArray()
    assert np.allclose(embedding.built_in_weights(model), wanted)


def test_null_and_no_texts(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "id long, text string")
    model = embedding.fit_embedder(df, dim=8)
    assert not any({r["id"]: r["vec"] for r in embedding.embed(df, model).collect()}[2])
    assert embedding.embed(df.limit(0), embedding.fit_embedder(df.limit(0), dim=8)).count() == 0


def test_texts_in_pieces_give_the_same_vectors(spark, monkeypatch):
    texts = [*TEXTS, None] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    model = embedding.fit_embedder(df, dim=32)
    whole = {r["id"]: r["vec"] for r in embedding.embed(df, model).collect()}
    batches = [pa.record_batch([pa.array(texts, pa.string())], ["text"])]
    monkeypatch.setattr(embedding, "PIECE_ROWS", 4)
    monkeypatch.setattr(embedding.F, "arrow_udf", lambda kind: lambda fn: fn)
    parts = list(embedding._hashed_vectors(embedding.built_in_weights(model))(b.column(0) for b in batches))
    assert [len(p) for p in parts] == [4] * 7 + [2]
    assert {i: v for i, v in enumerate(v for p in parts for v in p.to_pylist())} == whole


def test_a_task_remembers_few_words():
    place_of = embedding.word_places(64)
    tracemalloc.start()
    try:
        placed = [place_of(f"word{i}") for i in range(300_000)]
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
    assert placed[7] == place_of("word7") and len(set(placed)) == 64
