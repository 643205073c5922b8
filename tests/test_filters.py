import datetime as dt

import pytest

from conftest import ids
from triagelake.operators import filters


@pytest.fixture(scope="module")
def five(spark):
    base = dt.datetime(2024, 6, 1, 12, tzinfo=dt.timezone.utc)
    kinds = [("latency", "high"), ("outage", "critical"), ("deployment", "medium"), ("latency", "medium"), ("security", "critical")]
    rows = [(f"inc-{i + 1}", c, s, base + dt.timedelta(days=i)) for i, (c, s) in enumerate(kinds)]
    return spark.createDataFrame(rows, "id string, category string, severity string, created_at timestamp")


@pytest.mark.parametrize(
    "kw,expected",
    [
        (dict(categories=["latency"]), [1, 4]),
        (dict(categories=["latency", "outage"]), [1, 2, 4]),
        (dict(categories=["network"]), []),
        (dict(severities=["critical"]), [2, 5]),
        (dict(severities=["critical", "high"]), [1, 2, 5]),
        (dict(after="2024-06-03"), [3, 4, 5]),
        (dict(before="2024-06-02"), [1]),
        (dict(after="2024-06-02", before="2024-06-04"), [2, 3]),
        (dict(after=dt.date(2024, 6, 2), before=dt.datetime(2024, 6, 4, 12)), [2, 3, 4]),
        (dict(categories=["latency"], severities=["medium"]), [4]),
        (dict(categories=["latency"], after="2024-06-03"), [4]),
        (dict(), [1, 2, 3, 4, 5]),
        (dict(categories=["security"], severities=["low"]), []),
        (dict(categories=[]), []),
        (dict(severities=[]), []),
    ],
)
def test_filters(five, kw, expected):
    assert ids(filters.filter_incidents(five, **kw)) == [f"inc-{i}" for i in expected]
    assert ids(filters.filter_ids(five, **kw)) == [f"inc-{i}" for i in expected]


def test_filter_reaches_the_scan(five, spark, tmp_path):
    path = str(tmp_path / "t")
    five.write.partitionBy("category").parquet(path)
    found = filters.filter_incidents(spark.read.parquet(path), categories=["latency"], severities=["high"], after="2024-06-01")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    assert "EqualTo(severity,high)" in plan and "GreaterThanOrEqual(created" in plan


def test_lookup(five, spark):
    assert ids(filters.lookup(five, ["inc-2", "nope"])) == ["inc-2"]
    wanted = spark.createDataFrame([("inc-1",), ("inc-1",), ("nope",)], "id string")
    assert ids(filters.lookup(five, wanted)) == ["inc-1"]


def test_sets_and_order(five):
    a, b = five.filter("category = 'latency'"), five.filter("severity = 'medium'")
    assert ids(filters.union_ids(a, b, a)) == ["inc-1", "inc-3", "inc-4"]
    assert ids(filters.intersect_ids(a, b)) == ["inc-4"]
    assert [r["id"] for r in filters.by_time(five).collect()] == [f"inc-{i}" for i in range(1, 6)]


def test_labelled_only(spark):
    df = spark.createDataFrame([("a", "unknown"), ("b", "data")], "id string, category string")
    assert ids(filters.labelled_only(df)) == ["b"]
