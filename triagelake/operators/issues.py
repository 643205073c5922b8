"""From raw issues to incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.rules import (
    category_from_labels,
    category_of,
    issue_severity_of,
)
from triagelake.functions.text import query_text
from triagelake.functions.vocabulary import RESOLUTION_PATTERNS, RESOLUTION_PREFIX
from triagelake.operators.ranking import first_per_key, top_n_per_key
from triagelake.schema import UNKNOWN

# --- fixed values -----------------------------------------------------------
INCIDENT_LABELS = ["bug", "performance", "crash", "outage", "incident"]
MAX_PER_REPO = 50
# ----------------------------------------------------------------------------


def drop_pull_requests(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("pull_request").isNull())


def drop_empty_description(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.length("description") > 0)


def issue_quota(
    issues: DataFrame, labels: Sequence[str] = INCIDENT_LABELS, max_per_repo: int = MAX_PER_REPO
) -> DataFrame:
    """The most recently updated issues of each repository.

    Every wanted label contributes up to ``max_per_repo // len(labels)`` issues,
    closed issues of any label up to ``max_per_repo // 2``. ``branch_rank`` is
    the position of the label, closed issues come last. An issue picked by
    several branches is there several times; see `dedupe_issues`.
    """
    candidates = drop_pull_requests(issues)
    wanted = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    positions = F.array_distinct(
        F.array_compact(
            F.transform(
                F.coalesce(F.col("labels"), F.array().cast("array<struct<name:string>>")),
                lambda label: F.try_element_at(wanted, label["name"]),
            )
        )
    )
    closed = F.when(F.col("state") == "closed", F.array(F.lit(len(labels)))).otherwise(
        F.array().cast("array<int>")
    )
    branches = candidates.withColumn("branch_rank", F.explode(F.concat(positions, closed)))
    per_label, per_state = max_per_repo // len(labels), max_per_repo // 2
    newest = [F.desc("updated_at"), F.asc("id")]
    most = top_n_per_key(branches, ["repo", "branch_rank"], newest, max(per_label, per_state), "_place")
    cap = F.when(F.col("branch_rank") < len(labels), per_label).otherwise(per_state)
    return most.filter(F.col("_place") <= cap).drop("_place")


def dedupe_issues(picked: DataFrame) -> DataFrame:
    """One row per issue of a repository, from the branch that came first."""
    return first_per_key(picked, ["repo", "id"], [F.col("branch_rank")]).drop("branch_rank")


def extract_resolution(body: Column, state: Column) -> Column:
    """What closed the issue, as quoted from its text; null while it is open."""
    # i: ignore case, also beyond ASCII (u); d: only \n ends a line; U: Unicode blanks and digits
    found = [F.regexp_substr(body, F.lit("(?iduU)" + pattern)) for pattern in RESOLUTION_PATTERNS]
    return F.when(state == "closed", F.concat(F.lit(RESOLUTION_PREFIX), F.coalesce(*found)))


def infer_labels(
    issues: DataFrame, title: str = "title", body: str = "body", names: str = "names", engine: str = "scan"
) -> DataFrame:
    """Add ``category`` and ``severity``: by label, or by text where the labels say nothing.

    Done in steps, each a column of its own: issues decided by label hand an
    empty text to the keyword search.
    """
    lowered = F.lower(query_text(title, F.coalesce(F.col(body), F.lit(""))))
    by_label = F.col("_by_label")
    return (
        issues.withColumn("_lowered", lowered)
        .withColumn("_by_label", category_from_labels(names))
        .withColumn("_open", F.when(by_label == UNKNOWN, F.col("_lowered")).otherwise(""))
        .withColumn("_by_text", category_of(F.col("_open"), engine))
        .withColumn("category", F.when(by_label != UNKNOWN, by_label).otherwise(F.col("_by_text.category")))
        .withColumn("severity", issue_severity_of(F.col("_lowered"), F.col(names)))
        .drop("_lowered", "_by_label", "_open", "_by_text")
    )


def issues_to_incidents(issues: DataFrame, engine: str = "scan") -> DataFrame:
    """The incident form of each issue."""
    names = F.transform(
        F.coalesce(F.col("labels"), F.array().cast("array<struct<name:string>>")), lambda x: x["name"]
    )
    body = F.coalesce(F.col("body"), F.lit(""))
    metadata = F.to_json(
        F.struct(
            F.col("repo"),
            F.col("number").alias("issue_number"),
            F.col("html_url").alias("url"),
            F.col("state"),
            F.col("user.login").alias("author"),
            F.coalesce(F.col("comments"), F.lit(0)).alias("comments_count"),
        )
    )
    labelled = infer_labels(issues.withColumn("_names", names), names="_names", engine=engine)
    return labelled.select(
        F.concat(
            F.lit("gh-"), F.replace(F.col("repo"), F.lit("/"), F.lit("-")), F.lit("-"), F.col("number")
        ).alias("id"),
        F.col("title"),
        body.alias("description"),
        F.col("category"),
        F.col("severity"),
        F.lit("github").alias("source"),
        F.to_timestamp("created_at").alias("created_at"),
        F.to_timestamp("closed_at").alias("resolved_at"),
        extract_resolution(body, F.col("state")).alias("resolution"),
        F.col("_names").alias("labels"),
        metadata.alias("metadata"),
    )


def collect_incidents(
    issues: DataFrame, labels: Sequence[str] = INCIDENT_LABELS, max_per_repo: int = MAX_PER_REPO
) -> DataFrame:
    """Quota, one row per issue, conversion, and no empty descriptions."""
    picked = dedupe_issues(issue_quota(issues, labels, max_per_repo))
    return drop_empty_description(issues_to_incidents(picked))
