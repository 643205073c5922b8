import json

import pytest
from pyspark.sql import functions as F

from conftest import ids
from triagelake.operators import issues
from triagelake.functions.rules import infer_issue_severity
from triagelake.schema import RAW_ISSUE_SCHEMA
from triagelake.sources.issues import read_raw_issues


def raw(**kw):
    base = {
        "id": 1, "number": 123, "title": "Test", "body": "Body", "labels": [], "state": "open",
        "html_url": "https://x.invalid/1", "user": {"login": "u"}, "comments": 5,
        "created_at": "2024-01-15T10:30:00Z", "updated_at": "2024-01-15T10:30:00Z", "closed_at": None,
        "pull_request": None, "repo": "test/repo",
    }
    return {**base, **kw}


def frame(spark, rows):
    return spark.createDataFrame(rows, RAW_ISSUE_SCHEMA)


def label(*names):
    return [{"name": n} for n in names]


def test_conversion(spark):
    row = issues.issues_to_incidents(
        frame(spark, [raw(labels=label("bug", "P1"), state="closed", closed_at="2024-01-16T00:00:00Z", body="Fixed by #45")])
    ).first()
    assert row["id"] == "gh-test-repo-123"
    assert (row["category"], row["severity"], row["source"]) == ("outage", "high", "github")
    assert row["resolution"] == "Referenced: Fixed by #45"
    assert row["labels"] == ["bug", "P1"]
    assert json.loads(row["metadata"]) == {
        "repo": "test/repo", "issue_number": 123, "url": "https://x.invalid/1", "state": "closed", "author": "u", "comments_count": 5,
    }
    assert (row["resolved_at"] - row["created_at"]).total_seconds() == 13.5 * 3600


def test_text_decides_without_known_label(spark):
    rows = [raw(labels=label("question"), title="slow latency p99"), raw(id=2, number=2, labels=label("qqq"), body=None, comments=None)]
    got = issues.issues_to_incidents(frame(spark, rows)).orderBy("id").collect()
    assert [r["category"] for r in got] == ["latency", "unknown"]
    assert got[1]["description"] == "" and json.loads(got[1]["metadata"])["comments_count"] == 0


@pytest.mark.parametrize(
    "labels,title,expected",
    [
        (["priority/critical"], "x", "critical"), (["p1"], "x", "high"), (["priority/medium"], "x", "medium"),
        (["minor"], "x", "low"), ([], "CRITICAL: Production down", "high"), ([], "Minor update", "unknown"),
        ([], "a regression", "medium"), (["low", "P0"], "x", "critical"), (["lowest"], "x", "unknown"),
    ],
)
def test_severity(spark, labels, title, expected):
    df = spark.createDataFrame([(title, "", labels)], "title string, body string, labels array<string>")
    assert df.select(infer_issue_severity().alias("s")).first()["s"] == expected


@pytest.mark.parametrize(
    "body,expected",
    [
        ("Closed VIA #12 x", "Referenced: Closed VIA #12"),
        ("Fix: foo\rbar\nrest", "Referenced: Fix: foo\rbar\n"),
        ("prefix:   \n\nabc", "Referenced: fix:   \n\nabc"),
        ("none", None),
        ("solution: x, then fixed by #9", "Referenced: fixed by #9"),
    ],
)
def test_resolution(spark, body, expected):
    df = spark.createDataFrame([(body, "closed"), (body, "open")], "body string, state string")
    got = df.select(issues.extract_resolution(F.col("body"), F.col("state")).alias("r")).collect()
    assert [r["r"] for r in got] == [expected, None]


def test_quota_and_dedupe(spark):
    rows = [
        raw(id=i, number=i, labels=label("bug") if i % 2 else label("performance", "bug"), updated_at=f"2024-01-{i:02d}T00:00:00Z",
            state="closed" if i > 10 else "open", pull_request={"url": "x"} if i == 20 else None, body="" if i == 19 else "b")
        for i in range(1, 21)
    ]
    df = frame(spark, rows)
    picked = issues.issue_quota(df, ["bug", "performance"], 8)
    by_branch = {b: ids(picked.filter(F.col("branch_rank") == b)) for b in (0, 1, 2)}
    assert by_branch == {0: [16, 17, 18, 19], 1: [12, 14, 16, 18], 2: [16, 17, 18, 19]}
    assert ids(issues.dedupe_issues(picked)) == [12, 14, 16, 17, 18, 19]
    collected = issues.collect_incidents(df, ["bug", "performance"], 8)
    assert ids(collected) == sorted(f"gh-test-repo-{i}" for i in [12, 14, 16, 17, 18])


def test_read_dump(spark, tmp_path):
    path = tmp_path / "raw.json"
    no_repo = {k: v for k, v in raw().items() if k not in ("repo", "pull_request")}
    path.write_text(json.dumps([no_repo, {**no_repo, "id": 2, "pull_request": {"url": "u"}}], indent=2))
    df = read_raw_issues(spark, str(path), repo="a/b")
    assert ids(issues.drop_pull_requests(df)) == [1]
    assert df.first()["repo"] == "a/b"


def test_arrays_of_the_round_trip_are_bounded(spark, tmp_path, monkeypatch):
    """More rows make more files, not larger arrays, and none is lost."""
    import datetime as dt
    import os

    from checks import roundtrips

    monkeypatch.setattr(roundtrips, "ARRAY_CHARS", 3_000)
    paths, scratch_path = [], roundtrips.scratch_path

    def noted(spark, name):
        paths.append(scratch_path(spark, name))
        return paths[-1]

    monkeypatch.setattr(roundtrips, "scratch_path", noted)
    rows = [(i, i % 9, "F" if i % 2 else "O", 1.0, dt.date(2024, 1, 1 + i % 28), "1-URGENT") for i in [*range(1, 121), 5, 5]]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = roundtrips.raw_issues_round_trip(spark, str(tmp_path)).where("layout = 'array'").collect()
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in rows)
    folder = next(p for p in paths if "/issue-arrays-" in p)
    sizes = [os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-")]
    assert len(sizes) > 7 and max(sizes) < 4_500
