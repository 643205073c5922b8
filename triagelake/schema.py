"""Table schemas and the fixed vocabularies of the incident data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# List position is the ordinal of a value: it breaks ties between categories.
CATEGORIES = [
    "latency",
    "outage",
    "deployment",
    "config",
    "capacity",
    "data",
    "security",
    "dependency",
    "network",
    "unknown",
]
SEVERITIES = ["critical", "high", "medium", "low", "unknown"]
SOURCES = ["synthetic", "github", "kaggle", "manual"]
UNKNOWN = "unknown"

KNOWN_CATEGORIES = [c for c in CATEGORIES if c != UNKNOWN]

TITLE_MAX_CHARS = 500
DESCRIPTION_MAX_CHARS = 10_000
QUERY_MAX_CHARS = 5_000
# ----------------------------------------------------------------------------


def _fields(*specs: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in specs])


INCIDENT_SCHEMA = _fields(
    ("id", T.StringType(), False),
    ("title", T.StringType(), False),
    ("description", T.StringType(), False),
    ("category", T.StringType(), False),
    ("severity", T.StringType(), False),
    ("source", T.StringType(), False),
    ("created_at", T.TimestampType(), True),
    ("resolved_at", T.TimestampType(), True),
    ("resolution", T.StringType(), True),
    ("labels", T.ArrayType(T.StringType()), False),
    ("metadata", T.StringType(), False),
)
INCIDENT_COLUMNS = INCIDENT_SCHEMA.fieldNames()

CORRUPT = "_corrupt_record"

# As found in files: everything optional, instants as text, metadata as raw JSON text.
INCIDENT_FILE_SCHEMA = _fields(
    ("id", T.StringType(), True),
    ("title", T.StringType(), True),
    ("description", T.StringType(), True),
    ("category", T.StringType(), True),
    ("severity", T.StringType(), True),
    ("source", T.StringType(), True),
    ("created_at", T.StringType(), True),
    ("resolved_at", T.StringType(), True),
    ("resolution", T.StringType(), True),
    ("labels", T.ArrayType(T.StringType()), True),
    ("metadata", T.StringType(), True),
    (CORRUPT, T.StringType(), True),
)

RAW_ISSUE_SCHEMA = _fields(
    ("id", T.LongType(), True),
    ("number", T.LongType(), True),
    ("title", T.StringType(), True),
    ("body", T.StringType(), True),
    ("labels", T.ArrayType(_fields(("name", T.StringType(), True))), True),
    ("state", T.StringType(), True),
    ("html_url", T.StringType(), True),
    ("user", _fields(("login", T.StringType(), True)), True),
    ("comments", T.LongType(), True),
    ("created_at", T.StringType(), True),
    ("updated_at", T.StringType(), True),
    ("closed_at", T.StringType(), True),
    ("pull_request", _fields(("url", T.StringType(), True)), True),
    ("repo", T.StringType(), True),
)

GOLDEN_CASE_SCHEMA = _fields(
    ("id", T.StringType(), True),
    ("title", T.StringType(), True),
    ("description", T.StringType(), True),
    ("expected_category", T.StringType(), True),
    ("expected_severity", T.StringType(), True),
    ("expected_keywords", T.ArrayType(T.StringType()), True),
    ("should_cite_similar", T.BooleanType(), True),
)

CITATION_TYPE = _fields(
    ("incident_id", T.StringType(), True),
    ("text", T.StringType(), True),
    ("relevance", T.StringType(), True),
)
