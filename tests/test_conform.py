import json

import pytest
from pyspark.sql import functions as F

from conftest import ids
from triagelake.operators import conform
from triagelake.sources import incidents as files

GOOD = {"id": "a", "title": "T", "description": "", "source": "manual", "created_at": "2024-06-01T12:00:00Z"}


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_defaults_and_quarantine(spark, tmp_path):
    path = write(
        tmp_path / "x.jsonl",
        [
            GOOD,
            "",
            {**GOOD, "id": "b", "category": "latency", "severity": "high", "labels": ["x"], "metadata": {"n": 1, "s": [2]},
             "created_at": "2024-06-01T12:00:00", "resolution": ""},
            {**GOOD, "id": "c", "category": "weather"},
            {**GOOD, "id": "d", "severity": "worst", "source": "mail"},
            {"id": "e", "title": "no description", "source": "manual"},
            {**GOOD, "id": "f", "created_at": "soon"},
            "{not json",
        ],
    )
    valid, rejected = files.read_incidents(spark, path)
    rows = {r["id"]: r for r in valid.collect()}
    assert sorted(rows) == ["a", "b"]
    assert (rows["a"]["category"], rows["a"]["severity"], rows["a"]["labels"], rows["a"]["metadata"]) == (
        "unknown", "unknown", [], "{}",
    )
    assert json.loads(rows["b"]["metadata"]) == {"n": 1, "s": [2]}
    assert rows["a"]["created_at"] == rows["b"]["created_at"]
    reasons = {r["id"]: r["errors"] for r in rejected.collect()}
    assert reasons["c"] == ["invalid category: weather"]
    assert reasons["d"] == ["invalid severity: worst", "invalid source: mail"]
    assert reasons["e"] == ["missing description"]
    assert reasons["f"] == ["invalid created_at"]
    assert reasons[None] == ["malformed record"]


def test_missing_time_becomes_now(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", [{k: v for k, v in GOOD.items() if k != "created_at"}])
    valid, _ = files.read_incidents(spark, path)
    assert valid.filter(F.col("created_at") > F.current_timestamp() - F.make_interval(hours=F.lit(1))).count() == 1


def test_instants_without_zone_are_utc(spark):
    texts = ["2024-06-01T12:00:00", "2024-06-01 12:00:00Z", "2024-06-01T14:00:00+02:00", "2024-06-01", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = [r["s"] for r in df.orderBy("i").select(F.unix_timestamp(conform.utc_instant(F.col("t"))).alias("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    noon = 1717243200
    assert got == [noon, noon, noon, noon - 43200, None, None]


def test_failfast(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", [GOOD, {**GOOD, "category": "weather"}])
    valid, _ = files.read_incidents(spark, path, mode="failfast")
    with pytest.raises(Exception, match="invalid category: weather"):
        valid.collect()
    with pytest.raises(ValueError):
        files.read_incidents(spark, path, mode="other")


def test_directory_and_round_trip(spark, tmp_path):
    write(tmp_path / "one.jsonl", [GOOD, {**GOOD, "id": "b"}])
    write(tmp_path / "two.jsonl", [{**GOOD, "id": "b", "title": "again"}])
    write(tmp_path / "skip.txt", [{**GOOD, "id": "z"}])
    valid, _ = files.read_incident_dir(spark, str(tmp_path))
    assert ids(valid) == ["a", "b", "b"]
    assert valid.select("source_file").distinct().count() == 2

    plain = valid.drop("source_file").dropDuplicates(["id"]).withColumn("metadata", F.lit('{"k":{"n":1}}'))
    out = str(tmp_path / "out")
    files.write_incidents(plain, out, "json")
    files.write_incidents(plain, out, "json")  # replaces
    again, bad = files.read_incidents(spark, out)
    assert ids(again) == ["a", "b"] and bad.count() == 0
    assert json.loads(again.first()["metadata"]) == {"k": {"n": 1}}

    files.write_incidents(plain, str(tmp_path / "table"))
    table = files.read_incident_table(spark, str(tmp_path / "table"))
    assert ids(table) == ["a", "b"]
    with pytest.raises(ValueError):
        files.write_incidents(plain, out, "csv")


@pytest.mark.parametrize(
    "title,description,top_k,threshold,ok",
    [
        ("t", "d", 1, 0.0, True), ("", "d", 5, 0.3, False), (" ", "d", 5, 0.3, True),
        ("t" * 500, "d" * 10000, 20, 1.0, True), ("t" * 501, "d", 5, 0.3, False), ("t", "", 5, 0.3, False),
        ("t", "d" * 10001, 5, 0.3, False), ("t", "d", 0, 0.3, False), ("t", "d", 21, 0.3, False),
        ("t", "d", 5, -0.1, False), ("t", "d", 5, 1.1, False), (None, "d", 5, 0.3, False),
    ],
)
def test_analyze_bounds(spark, title, description, top_k, threshold, ok):
    row = spark.createDataFrame(
        [(title, description, top_k, threshold)], "title string, description string, top_k int, similarity_threshold double"
    )
    valid, rejected = conform.validate_inputs(row)
    assert (valid.count(), rejected.count()) == ((1, 0) if ok else (0, 1))


@pytest.mark.parametrize("length,top_k,ok", [(0, 5, False), (1, 50, True), (5000, 1, True), (5001, 1, False), (1, 51, False)])
def test_search_bounds(spark, length, top_k, ok):
    row = spark.createDataFrame([("q" * length, top_k)], "query string, top_k int")
    valid, _ = conform.validate_inputs(row, "search")
    assert valid.count() == int(ok)


def test_require_rows(spark):
    conform.require_rows(spark.range(3), 3, "rows")
    with pytest.raises(ValueError, match="need at least 4 rows, got 3"):
        conform.require_rows(spark.range(3), 4, "rows")
