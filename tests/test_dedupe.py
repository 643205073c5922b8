import pytest
from pyspark.sql import functions as F

from conftest import ids
from triagelake.operators import dedupe, profile, ranking

SCHEMA = "id string, title string, seq int"


def test_titles_first_wins(spark):
    df = spark.createDataFrame([("a", " API Down\t", 1), ("b", "api down", 2), ("c", "other", 3)], SCHEMA)
    kept = dedupe.dedupe_titles(df, [F.col("seq")])
    assert ids(kept) == ["a", "c"]
    assert ids(dedupe.dedupe_titles(kept, [F.col("seq")])) == ["a", "c"]


def test_latest_by_id(spark):
    df = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "only", 1)], SCHEMA)
    latest = dedupe.latest_by_id(df, ["seq"])
    assert {r["id"]: r["title"] for r in latest.collect()} == {"a": "new", "b": "only"}
    assert dedupe.latest_by_id(latest, ["seq"]).exceptAll(latest).count() == 0


def test_combine_prefers_lower_rank(spark):
    first = spark.createDataFrame([("s", "Same", 9)], SCHEMA)
    second = spark.createDataFrame([("g", "same ", 1), ("h", "else", 2)], SCHEMA)
    seq = [F.col("seq")]
    assert ids(dedupe.combine_sources([(0, first), (1, second)], seq=seq)) == ["h", "s"]
    assert ids(dedupe.combine_sources([(1, first), (0, second)], seq=seq)) == ["g", "h"]
    assert ids(dedupe.combine_sources([(0, first), (1, second)], dedupe=False)) == ["g", "h", "s"]


def test_hot_title_is_cut_before_the_shuffle(spark):
    df = spark.range(0, 20000, 1, 8).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("title"),
        F.col("id").cast("int").alias("seq"),
    )
    kept = dedupe.dedupe_titles(df, [F.col("seq")])
    assert kept.filter("title = 'hot'").select("id").collect()[0]["id"] == "0"
    assert kept.count() == 20000 - 6667 + 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once per input partition, once per key


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_top_n_equals_plain_ranking(spark, n):
    df = spark.range(0, 9000, 1, 7).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 9000).alias("v"))
    got = ranking.top_n_per_key(df, ["k"], [F.desc("v")], n, rank="r")
    rows = sorted(tuple(r) for r in got.select("k", "r", "v").collect())
    expected = []
    for k in range(3):
        values = sorted(((i * 7919) % 9000 for i in range(9000) if i % 3 == k), reverse=True)[:n]
        expected += [(k, i + 1, v) for i, v in enumerate(values)]
    assert rows == sorted(expected)


def test_stats(spark):
    rows = [("data", "high", "manual", "x"), ("data", "low", "github", ""), ("outage", "low", "github", None)]
    df = spark.createDataFrame(rows, "category string, severity string, source string, resolution string")
    got = {(r["dimension"], r["value"]): (r["incidents"], r["with_resolution"]) for r in profile.incident_stats(df).collect()}
    assert got == {
        ("total", "all"): (3, 1), ("category", "data"): (2, 1), ("category", "outage"): (1, 0),
        ("severity", "high"): (1, 1), ("severity", "low"): (2, 0), ("source", "manual"): (1, 1), ("source", "github"): (2, 0),
    }
    assert profile.incident_stats(df.limit(0)).count() == 0
