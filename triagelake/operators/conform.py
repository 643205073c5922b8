"""Bring records to the incident schema and set bad ones aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.schema import (
    CATEGORIES,
    CORRUPT,
    DESCRIPTION_MAX_CHARS,
    INCIDENT_COLUMNS,
    QUERY_MAX_CHARS,
    SEVERITIES,
    SOURCES,
    TITLE_MAX_CHARS,
    UNKNOWN,
)

ERRORS = "errors"
REQUIRED = ["id", "title", "description", "source"]


def conform_incidents(df: DataFrame) -> DataFrame:
    """Fill defaults and list what is wrong with each record in ``errors``.

    Missing optional columns are added. Instants given as text are read as UTC
    unless they name a zone. Other columns of the input stay as they are.
    """
    present = set(df.columns)

    def given(name: str, dtype: str = "string") -> Column:
        return F.col(name) if name in present else F.lit(None).cast(dtype)

    def instant(name: str) -> Column:
        if name not in present:
            return F.lit(None).cast("timestamp")
        if dict(df.dtypes)[name] == "string":
            return utc_instant(F.col(name))
        return F.col(name).cast("timestamp")

    problems = [
        F.when(given(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED
    ] + [
        F.when(~given(name).isin(domain), F.concat(F.lit(f"invalid {name}: "), given(name)))
        for name, domain in [("category", CATEGORIES), ("severity", SEVERITIES), ("source", SOURCES)]
    ] + [
        F.when(given(name).isNotNull() & instant(name).isNull(), F.lit(f"invalid {name}"))
        for name in ["created_at", "resolved_at"]
    ]
    if CORRUPT in present:
        errors = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("malformed record"))).otherwise(
            F.array_compact(F.array(*problems))
        )
    else:
        errors = F.array_compact(F.array(*problems))

    columns = {
        "category": F.coalesce(given("category"), F.lit(UNKNOWN)),
        "severity": F.coalesce(given("severity"), F.lit(UNKNOWN)),
        "created_at": F.coalesce(instant("created_at"), F.current_timestamp())
        if "created_at" not in present
        else F.when(given("created_at").isNull(), F.current_timestamp()).otherwise(instant("created_at")),
        "resolved_at": instant("resolved_at"),
        "labels": F.coalesce(given("labels", "array<string>"), F.array().cast("array<string>")),
        "metadata": F.coalesce(given("metadata"), F.lit("{}")),
    }
    kept = [F.col(c) for c in df.columns if c not in INCIDENT_COLUMNS]
    return df.select(
        *[columns.get(c, given(c)).alias(c) for c in INCIDENT_COLUMNS], *kept, errors.alias(ERRORS)
    )


def utc_instant(text: Column) -> Column:
    """ISO text as an instant, null if it is none; without a zone it means UTC."""
    zoned = text.rlike(r"(?:[Zz]|UTC|[+-]\d{2}:?\d{2})$")
    midnight = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(midnight, F.lit("Z"))))


def validate_inputs(queries: DataFrame, profile: str = "analyze") -> tuple[DataFrame, DataFrame]:
    """Split request rows into ``(valid, rejected)``.

    profile="analyze" checks title, description, top_k and similarity_threshold;
    profile="search" checks query, top_k and threshold. Columns the table does
    not have are not checked. Blanks count as characters.
    """
    bounds = {
        "analyze": [
            ("title", "chars", 1, TITLE_MAX_CHARS),
            ("description", "chars", 1, DESCRIPTION_MAX_CHARS),
            ("top_k", "value", 1, 20),
            ("similarity_threshold", "value", 0.0, 1.0),
        ],
        "search": [
            ("query", "chars", 1, QUERY_MAX_CHARS),
            ("top_k", "value", 1, 50),
            ("threshold", "value", 0.0, 1.0),
        ],
    }[profile]
    problems = []
    for name, kind, low, high in bounds:
        if name not in queries.columns:
            continue
        measure = F.char_length(name) if kind == "chars" else F.col(name)
        unit = " characters" if kind == "chars" else ""
        # A term left out takes its default; a text must be there.
        left_out = F.lit(kind == "value")
        problems.append(
            F.when(
                ~F.coalesce(measure.between(low, high), left_out),
                F.lit(f"{name} must be {low} to {high}{unit}"),
            )
        )
    return split_valid(queries.withColumn(ERRORS, F.array_compact(F.array(*problems))))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size(ERRORS) == 0
    return checked.filter(ok).drop(ERRORS, CORRUPT), checked.filter(~ok)


def require_valid(checked: DataFrame) -> DataFrame:
    """Fail the job on the first bad record."""
    ok = F.size(ERRORS) == 0
    return checked.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.array_join(ERRORS, "; "))))


def clamp_score(score: Column) -> Column:
    """Scores live in [0, 1]; rounding may push one slightly past the end."""
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def require_rows(df: DataFrame, at_least: int, what: str) -> None:
    """Raise when there are too few rows; reads no more than needed to know."""
    found = df.limit(at_least).count()
    if found < at_least:
        raise ValueError(f"need at least {at_least} {what}, got {found}")
