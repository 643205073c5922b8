"""The classification rules in SQL."""

from __future__ import annotations

from checks.tables import sql_list, sql_str
from triagelake.functions.vocabulary import (
    CATEGORY_KEYWORDS,
    ISSUE_SEVERITY_LABELS,
    ISSUE_SEVERITY_PHRASES,
    LABEL_CATEGORIES,
    SEVERITY_PHRASES,
)


def keyword_scores(source: str, key: str, text: str) -> str:
    """CTEs ``hits`` and ``by_text(key, category, confidence)``."""
    sums = ", ".join(
        "(" + " + ".join(f"contains(t, {sql_str(w)})::INT" for w in words) + f") AS {category}_n"
        for category, words in CATEGORY_KEYWORDS.items()
    )
    names = list(CATEGORY_KEYWORDS)
    top = "greatest(" + ", ".join(f"{c}_n" for c in names) + ")"
    cases = " ".join(f"WHEN {c}_n = top THEN {sql_str(c)}" for c in names)
    return f"""hits AS (SELECT {key}, {sums} FROM (SELECT {key}, lower({text}) AS t FROM {source})),
by_text AS (SELECT {key}, CASE WHEN top = 0 THEN 'unknown' {cases} END AS category,
                   least(top / 3.0, 1.0)::DOUBLE AS confidence
            FROM (SELECT *, {top} AS top FROM hits))"""


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_str(p)})" for p in phrases) + ")"


def severity_case(text: str) -> str:
    cases = " ".join(f"WHEN {_any(text, phrases)} THEN {sql_str(s)}" for s, phrases in SEVERITY_PHRASES)
    return f"CASE {cases} ELSE 'medium' END"


def issue_severity_case(text: str, labels: str) -> str:
    """``labels`` is a list of lower-case names."""
    by_label = " ".join(
        f"WHEN list_has_any({labels}, {sql_list(names)}) THEN {sql_str(s)}" for s, names in ISSUE_SEVERITY_LABELS
    )
    by_text = " ".join(
        f"WHEN {_any(text, phrases)} THEN {sql_str(s)}" for s, phrases in ISSUE_SEVERITY_PHRASES
    )
    return f"CASE {by_label} {by_text} ELSE 'unknown' END"


def label_category(source: str, key: str, labels: str = "labels") -> str:
    """CTE ``by_label(key, category)``."""
    values = ", ".join(
        f"({sql_str(name)}, {sql_str(category)}, {i})" for i, (name, category) in enumerate(LABEL_CATEGORIES.items())
    )
    return f"""one AS (SELECT {key}, lower(unnest({labels})) AS label, generate_subscripts({labels}, 1) AS pos FROM {source}),
known(name, category, place) AS (VALUES {values}),
exact AS (SELECT {key}, arg_min(category, pos) AS category FROM one JOIN known ON label = name GROUP BY {key}),
partial AS (SELECT {key}, arg_min(category, pos * 1000 + place) AS category
            FROM one JOIN known ON contains(label, name) OR contains(name, label) GROUP BY {key}),
by_label AS (SELECT s.{key}, coalesce(e.category, p.category, 'unknown') AS category
             FROM {source} s LEFT JOIN exact e USING ({key}) LEFT JOIN partial p USING ({key}))"""
