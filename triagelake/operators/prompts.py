"""Prompts from queries and their similar incidents."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import first_chars, has_resolution, two_decimals

# --- fixed values -----------------------------------------------------------
NO_SIMILAR = "No similar incidents found."
NOT_RESOLVED = "Not resolved yet"
DESCRIPTION_CHARS = 500

SIMILAR_BLOCK = """
### Similar Incident {rank} (Similarity: {score})
- ID: {id}
- Title: {title}
- Category: {category}
- Severity: {severity}
- Description: {description}...
- Resolution: {resolution}
"""

FEEDBACK = """

Previous attempt failed validation: {error}
Please fix the issue and provide a valid JSON response."""
# ----------------------------------------------------------------------------

# Our own wording; callers with a template of theirs pass it in.
DEFAULT_TEMPLATE = """A new incident has come in. Work out what is behind it, using the past incidents below.

## What was reported
Title: {title}
Description: {description}
Category: {category}
Severity: {severity}

## What happened before
{similar_incidents}

## What to send back

Reply with one JSON object and nothing else, with these keys:
{{
    "root_cause_hypothesis": "the likeliest cause, and which past incidents point to it",
    "recommended_actions": ["what to do first", "what to do next"],
    "estimated_impact": "who and what is affected",
    "analysis_summary": "two or three sentences for a status page",
    "citations": [
        {{"incident_id": "id of a past incident", "text": "what it says", "relevance": "why it matters here"}}
    ]
}}
"""


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template in brace notation as one concatenation; ``{{`` stands for a brace."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def similar_block() -> Column:
    """One past incident as prompt text; blanks out no row because of a null field."""
    return fill(
        SIMILAR_BLOCK,
        {
            "rank": F.col("rank").cast("string"),
            "score": two_decimals("score"),
            "id": F.col("incident_id"),
            "title": F.col("title"),
            "category": F.col("category"),
            "severity": F.col("severity"),
            "description": first_chars("description", DESCRIPTION_CHARS),
            "resolution": F.when(has_resolution(), F.col("resolution")).otherwise(NOT_RESOLVED),
        },
    )


def format_similar(found: DataFrame) -> DataFrame:
    """``(query_id, similar_incidents)``: the hits of each query as one text.

    A query has at most as many hits as were asked for, so the lists are short.
    """
    blocks = found.select("query_id", F.struct("rank", similar_block().alias("block")).alias("item"))
    return blocks.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("item")), lambda i: i["block"]), "\n"
        ).alias("similar_incidents")
    )


def build_prompts(queries: DataFrame, found: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """``(query_id, prompt)`` for classified queries, with or without hits."""
    similar = F.coalesce("similar_incidents", F.lit(NO_SIMILAR))
    return queries.join(format_similar(found), "query_id", "left").select(
        "query_id",
        fill(
            template,
            {
                "title": F.col("title"),
                "description": F.col("description"),
                "category": F.col("predicted_category"),
                "severity": F.col("predicted_severity"),
                "similar_incidents": similar,
            },
        ).alias("prompt"),
    )


def with_feedback(prompt: Column, error: Column) -> Column:
    """Tell the model what was wrong with its previous answer, if anything was."""
    return F.when(error.isNotNull(), F.concat(prompt, fill(FEEDBACK, {"error": error}))).otherwise(prompt)
