"""Reading a model's text answer: find the JSON object, check it, take it apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions.binding import bind
from triagelake.functions.text import _col
from triagelake.schema import CITATION_TYPE

# --- fixed values -----------------------------------------------------------
REQUIRED_FIELDS = [
    ("root_cause_hypothesis", "str"),
    ("recommended_actions", "list"),
    ("estimated_impact", "str"),
    ("analysis_summary", "str"),
]
NO_RESPONSE = "LLM response is None"
BAD_ACTIONS = "All items in 'recommended_actions' must be strings"
CITATION_DEFAULTS = {"incident_id": "unknown", "text": "", "relevance": ""}
# ----------------------------------------------------------------------------


def json_text(response: str | Column) -> Column:
    """The part of an answer that should be JSON.

    A fence marked json wins over a plain fence, a fence over the bare text; an
    unclosed fence reaches to the end. Of that, the first opening to the last
    closing brace.
    """
    text = _col(response)
    fenced = (
        F.when(F.contains(text, F.lit("```json")), _after(text, "```json"))
        .when(F.contains(text, F.lit("```")), _after(text, "```"))
        .otherwise(text)
    )
    body = F.substring_index(fenced, "```", 1)
    return F.regexp_substr(body, F.lit(r"(?s)\{.*\}"))


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.locate(mark, text) + len(mark))


def extract_json(response: str | Column) -> Column:
    """The answer as VARIANT; null when there is no valid JSON object in it."""
    return F.try_parse_json(json_text(response))


def _python_type(kind: Column) -> Column:
    """What a Python reader of a JSON value would call its type, from the kind Spark gives it."""
    return (
        F.when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "VOID", "NoneType")
        .when(F.startswith(kind, F.lit("ARRAY")), "list")
        .when(F.startswith(kind, F.lit("OBJECT")), "dict")
        .when(kind == "BIGINT", "int")
        .otherwise("float")
    )


def _field_problem(name: str, wanted: str, kind: Column) -> Column:
    """Null if the field is there and of the wanted type. The kind is found once, and named once."""
    return bind(
        bind(kind, lambda k: F.when(k.isNotNull(), _python_type(k))),
        lambda found: F.when(found.isNull(), F.lit(f"Missing required field: {name}")).when(
            found != wanted, F.concat(F.lit(f"Field '{name}' expected {wanted}, got "), found)
        ),
    )


def validate_response(answer: str | Column) -> Column:
    """``struct<passed, error>`` for an answer given as VARIANT."""
    v = _col(answer)
    problems = []
    for name, wanted in REQUIRED_FIELDS:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        problems.append(_field_problem(name, wanted, kind))
    actions = F.try_variant_get(v, "$.recommended_actions", "array<variant>")
    problems.append(
        F.when(
            F.exists(actions, lambda a: F.coalesce(F.schema_of_variant(a) != "STRING", F.lit(True))),
            F.lit(BAD_ACTIONS),
        )
    )
    listed = F.array_join(F.array_compact(F.array(*problems)), "; ")
    error = F.when(v.isNull(), F.lit(NO_RESPONSE)).when(listed != "", listed)
    return F.struct(error.isNull().alias("passed"), error.alias("error"))


def text_field(answer: str | Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(_col(answer), f"$.{name}", "string"), F.lit(""))


def parse_actions(answer: str | Column) -> Column:
    actions = F.try_variant_get(_col(answer), "$.recommended_actions", "array<string>")
    return F.coalesce(actions, F.array().cast("array<string>"))


def parse_citations(answer: str | Column) -> Column:
    """Object items of the citation list; keys they lack get defaults."""
    items = F.try_variant_get(_col(answer), "$.citations", "array<variant>")
    objects = F.filter(items, lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT")))
    citations = F.transform(
        objects,
        lambda c: F.struct(
            *[
                F.coalesce(F.try_variant_get(c, f"$.{name}", "string"), F.lit(default)).alias(name)
                for name, default in CITATION_DEFAULTS.items()
            ]
        ),
    )
    none = F.array().cast(f"array<{CITATION_TYPE.simpleString()}>")
    return F.coalesce(citations, none)
