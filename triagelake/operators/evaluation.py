"""Scores of analysis results against golden cases.

Results have one row per case, with ``case_id``, the predicted fields, the
arrays ``similar_incidents``, ``recommended_actions`` and ``citations`` and the
answer texts. Cases come from `read_golden_cases`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.binding import bind


def score_classification() -> list[Column]:
    return [
        (F.col("predicted_category") == F.col("expected_category")).alias("category_correct"),
        (F.col("predicted_severity") == F.col("expected_severity")).alias("severity_correct"),
    ]


def score_retrieval() -> list[Column]:
    hits, citations = _count("similar_incidents"), _count("citations")
    required = F.coalesce(F.col("should_cite_similar"), F.lit(False))
    return [
        hits.alias("retrieved_count"),
        (hits > 0).alias("has_similar_incidents"),
        citations.alias("citation_count"),
        (~required | (citations > 0)).alias("has_required_citations"),
    ]


def keywords_found() -> Column:
    """How many expected keywords occur in cause, actions and summary."""
    said = F.lower(
        F.concat_ws(
            " ",
            _text("root_cause_hypothesis"),
            F.array_join(F.coalesce("recommended_actions", F.array().cast("array<string>")), " "),
            _text("analysis_summary"),
        )
    )
    return bind(said, lambda t: F.size(F.filter(_expected(), lambda word: F.contains(t, F.lower(word)))))


def score_analysis(found: Column) -> list[Column]:
    """Scores of the answer texts; ``found`` holds `keywords_found`."""
    expected = F.size(_expected())
    return [
        (F.length(_text("root_cause_hypothesis")) > 0).alias("has_root_cause"),
        (_count("recommended_actions") > 0).alias("has_actions"),
        _count("recommended_actions").alias("action_count"),
        (F.length(_text("analysis_summary")) > 0).alias("has_summary"),
        found.alias("keywords_found"),
        expected.alias("keywords_expected"),
        F.when(expected == 0, F.lit(1.0)).otherwise(F.try_divide(found, expected)).alias("keyword_coverage"),
    ]


def _expected() -> Column:
    return F.coalesce("expected_keywords", F.array().cast("array<string>"))


def _count(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def score_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case. A case without a successful result is a failure.

    ``results`` may carry ``success``, ``error`` and ``latency_seconds``.
    """
    have = set(results.columns)
    success = F.col("success") if "success" in have else F.lit(True)
    extra = {
        "_success": F.coalesce(success, F.lit(False)),
        "_error": F.col("error") if "error" in have else F.lit(None).cast("string"),
        "_latency": F.col("latency_seconds") if "latency_seconds" in have else F.lit(None).cast("double"),
    }
    judged = results.select(
        "case_id",
        "predicted_category",
        "predicted_severity",
        "category_confidence",
        "similar_incidents",
        "citations",
        "recommended_actions",
        "root_cause_hypothesis",
        "analysis_summary",
        *[c.alias(n) for n, c in extra.items()],
    )
    joined = cases.join(judged, "case_id", "left").withColumn("_found", keywords_found())
    ok = F.coalesce(F.col("_success"), F.lit(False))
    scores = [*score_classification(), *score_retrieval(), *score_analysis(F.col("_found"))]
    names = [
        "category_correct", "severity_correct", "retrieved_count", "has_similar_incidents",
        "citation_count", "has_required_citations", "has_root_cause", "has_actions",
        "action_count", "has_summary", "keywords_found", "keywords_expected", "keyword_coverage",
    ]
    return joined.select(
        "case_id",
        "title",
        ok.alias("success"),
        F.when(~ok, F.coalesce("_error", F.lit("no result"))).alias("error"),
        F.when(ok, F.col("_latency")).alias("latency_seconds"),
        "expected_category",
        "expected_severity",
        *[F.when(ok, F.col(c)).alias(c) for c in ["predicted_category", "predicted_severity", "category_confidence"]],
        *[F.when(ok, score).alias(name) for name, score in zip(names, scores)],
    )


def evaluation_summary(per_case: DataFrame) -> DataFrame:
    """One row of rates over the cases that succeeded; zeros and an error when none did."""
    ok = F.col("success")

    def mean(col: Column) -> Column:
        return F.coalesce(F.avg(F.when(ok, col.cast("double"))), F.lit(0.0))

    return per_case.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(ok).alias("successful_cases"),
        F.coalesce(F.try_divide(F.count_if(ok), F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"),
        mean(F.col("latency_seconds")).alias("avg_latency_seconds"),
        mean(F.col("category_correct")).alias("category_accuracy"),
        mean(F.col("severity_correct")).alias("severity_accuracy"),
        mean(F.col("retrieved_count")).alias("avg_retrieved"),
        mean(F.col("has_required_citations")).alias("citation_rate"),
        mean(F.col("has_root_cause")).alias("root_cause_rate"),
        mean(F.col("action_count")).alias("avg_actions"),
        mean(F.col("keyword_coverage")).alias("avg_keyword_coverage"),
        F.when(F.count_if(ok) == 0, F.lit("All evaluations failed")).alias("error"),
    )


def first_cases(cases: DataFrame, n: int) -> DataFrame:
    return cases.orderBy("case_id").limit(n)


def evaluate(results: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(per_case, summary)``."""
    per_case = score_cases(results, cases)
    return per_case, evaluation_summary(per_case)
