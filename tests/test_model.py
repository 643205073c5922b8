import math

import pytest
from pyspark.sql import functions as F

from checks import classification
from conftest import ids
from triagelake.operators import classifier, metrics, splitting
from triagelake.operators.classify import classify
from triagelake.schema import CATEGORIES
from triagelake.sources.models import load_model, model_metadata, save_model

TEXTS = [
    ("latency", "slow response times on checkout", "p99 latency increased sharply"),
    ("latency", "high latency alerts", "requests are slow and time out"),
    ("outage", "service is down", "complete outage with 503 errors"),
    ("outage", "production unavailable", "service down and unreachable"),
    ("security", "certificate expired", "tls certificate vulnerability found"),
    ("security", "unauthorized access", "security breach by stolen credentials"),
    ("data", "database migration failed", "schema corruption in postgres"),
    ("data", "replication lag", "database replica returns stale rows"),
    ("network", "dns resolution failure", "dns lookups fail behind the proxy"),
    ("network", "load balancer issue", "tcp connections reset by firewall"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"i{n}-{r}", t, d, c) for r in range(3) for n, (c, t, d) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id string, title string, description string, category string")


@pytest.fixture(scope="module")
def trained(labelled):
    return classifier.train_classifier(labelled, max_iter=30)


def test_training(trained, labelled):
    model, m = trained
    assert all(0 <= m[k] <= 1 for k in ("accuracy", "macro_f1", "weighted_f1"))
    assert m["train_size"] + m["test_size"] == 30 and m["test_size"] == 5
    assert m["confusion_matrix"].count() == 81
    got = classifier.predict(model, labelled.drop("category"))
    assert got.columns == ["id", "title", "description", "predicted", "confidence"]
    assert got.filter(~F.col("predicted").isin(CATEGORIES) | ~F.col("confidence").between(0, 1)).count() == 0
    right = got.join(labelled.select("id", "category"), "id").filter("predicted = category").count()
    assert right >= 27
    judged = classify(labelled.drop("category"), model).first()
    assert judged["predicted_category"] in CATEGORIES and judged["predicted_severity"]


def test_only_labelled_documents_are_judged_for_training(spark, tmp_path, monkeypatch):
    docs = spark.range(20).selectExpr("id as doc_id", "'en' as lang", "'web' as source", "9L as n_chars", "'slow text' as text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 20, 5).selectExpr("id as doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    judged = []

    def seen(df, *args):
        judged.append(df)
        return classify(df, *args)

    monkeypatch.setattr(classification, "classify", seen)
    with pytest.raises(ValueError, match="need at least 10"):
        classification.train_and_predict(spark, str(tmp_path))
    assert sorted(r["id"] for r in judged[0].collect()) == ["doc-0", "doc-10", "doc-15", "doc-5"]


def test_too_few_rows(labelled):
    with pytest.raises(ValueError, match="need at least 10"):
        classifier.train_classifier(labelled.limit(5))
    with pytest.raises(ValueError, match="neither trained nor loaded"):
        classifier.predict(None, labelled)
    with pytest.raises(ValueError):
        save_model(None, "/nowhere")


def test_save_and_load(trained, labelled, spark, tmp_path):
    model, _ = trained
    path = str(tmp_path / "m")
    save_model(model, path)
    a = classifier.predict(model, labelled).select("id", "predicted", "confidence")
    b = classifier.predict(load_model(path), labelled).select("id", "predicted", "confidence")
    assert sorted(a.collect()) == sorted(b.collect())
    meta = model_metadata(spark, path)
    assert meta["categories"] == ["data", "latency", "network", "outage", "security"]
    assert meta["feature_names"] == sorted(meta["feature_names"]) and len(meta["feature_names"]) <= 100


def test_split_is_stratified(spark):
    df = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, "big").when(F.col("id") < 40, "mid").otherwise(F.concat(F.lit("c"), F.col("id") % 4)).alias("category")
    )
    df = df.unionByName(spark.createDataFrame([(5000, "single")], "id long, category string"))
    for seed in (1, 42):
        split = splitting.stratified_split(df, 0.2, seed)
        assert split.count() == 1001 and split.columns == ["id", "category", "is_test"]
        for r in split.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
            assert r["t"] == math.floor(0.2 * r["n"] + 0.5)
    again = splitting.stratified_split(df.repartition(7), 0.2, 42)
    assert ids(again.filter("is_test")) == ids(splitting.stratified_split(df, 0.2, 42).filter("is_test"))
    assert splitting.stratified_split(df, 0.0).filter("is_test").count() == 0
    assert splitting.stratified_split(df, 1.0).filter("not is_test").count() == 0


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "Disk full, disk slow"), (2, "disk ok"), (3, "ok ok full"), (4, "")], "id int, text string")
    got = {(r["id"], r["term"]): r for r in classifier.tfidf_table(df).collect()}
    assert {t for _, t in got} == {"disk", "full", "ok"}
    assert got[(1, "disk")]["tf"] == 2 and got[(3, "ok")]["tf"] == 2
    idf = {t: math.log(5 / 3) + 1 for t in ("disk", "full", "ok")}
    assert got[(1, "disk")]["idf"] == pytest.approx(idf["disk"])
    assert got[(1, "disk")]["weight"] == pytest.approx(2 / math.sqrt(5))
    assert classifier.tfidf_table(df, min_documents=9).count() == 0
    counts = classifier.term_counts(classifier.text_terms(df, stop_words=["disk"]))
    assert sorted((r["id"], r["term"], r["tf"]) for r in counts.collect()) == [
        (1, "full", 1), (1, "full slow", 1), (1, "slow", 1), (2, "ok", 1),
        (3, "full", 1), (3, "ok", 2), (3, "ok full", 1), (3, "ok ok", 1),
    ]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "category string")
    assert {r["category"]: r["weight"] for r in classifier.class_weights(df).collect()} == {"a": 4 / 6, "b": 2.0}


@pytest.fixture(scope="module")
def judged(spark):
    pairs = [("data", "data")] * 4 + [("data", "outage")] * 2 + [("outage", "outage")] * 3 + [("network", "data")]
    return spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(pairs)], "id int, actual string, predicted string")


def test_report(judged):
    report = {r["label"]: r for r in metrics.classification_report(judged).collect()}
    assert (report["data"]["precision"], report["data"]["recall"], report["data"]["support"]) == (0.8, pytest.approx(4 / 6), 6)
    assert (report["network"]["precision"], report["network"]["recall"], report["network"]["f1_score"]) == (0, 0, 0)
    assert report["accuracy"]["f1_score"] == 0.7 and report["accuracy"]["support"] == 10
    f1 = [8 / 11, 6 / 8, 0]
    assert report["macro avg"]["f1_score"] == pytest.approx(sum(f1) / 3)
    assert report["weighted avg"]["f1_score"] == pytest.approx((f1[0] * 6 + f1[1] * 3) / 10)


def test_confusions(judged):
    wide = metrics.confusion_matrix_wide(judged).collect()
    assert [r["actual"] for r in wide] == CATEGORIES[:-1]
    assert sum(sum(r[1:]) for r in wide) == 10
    assert [tuple(r) for r in metrics.top_confusions(judged, 1).collect()] == [("data", "outage", 2)]
    assert tuple(metrics.accuracy(judged).first()) == (10, 7, 0.7)
    assert tuple(metrics.accuracy(judged.limit(0)).first()) == (0, 0, 0.0)
    sample = metrics.sample_predictions(judged, 4)
    assert ids(sample.filter("correct")) == [0, 1] and ids(sample.filter("not correct")) == [4, 5]


def test_vocabulary_is_counted_in_rows(spark, monkeypatch):
    """Terms in the order of their counts, then of the terms; cut anywhere, over partitions too; weights as plain ones."""

    def no_fit(self, dataset, params=None):
        raise AssertionError("terms are counted as objects")

    monkeypatch.setattr(classifier.CountVectorizer, "fit", no_fit)
    texts = [f"w{i % 5} w{i % 5} v{i % 7} rare{i} all" for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    cut_up = []
    for t in texts:
        words = t.split()
        cut_up.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = {term: sum(term in terms for terms in cut_up) for terms in cut_up for term in terms}
    total = {term: sum(terms.count(term) for terms in cut_up) for term in df}
    known = sorted((t for t in df if 2 <= df[t] <= 0.95 * len(texts)), key=lambda t: (-total[t], t))
    for most in (1, 4, 9, len(known), classifier.MOST_FEATURES):
        counter, scale = classifier.tfidf_features(docs, "text", most, [])[-3:-1]
        assert counter.vocabulary == known[:most]
        wanted = [math.log((1 + len(texts)) / (df[t] + 1)) + 1 for t in known[:most]]
        assert list(scale.getScalingVec()) == pytest.approx(wanted, abs=1e-12)
    with pytest.raises(ValueError, match="no term"):
        classifier.tfidf_features(docs.limit(1), "text", 5, [])
