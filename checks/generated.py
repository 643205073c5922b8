"""Generated incidents, one per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import sql_choice, sql_list, sql_str, table
from triagelake.operators import synth
from triagelake.schema import KNOWN_CATEGORIES

QUERIES: dict = {}

_AS_OF = "2024-06-01"


def _draw(token: str, n: int) -> str:
    a, b = synth.coefficients(token)
    return f"((((seed % {synth.PRIME}) * {a} + {b}) % {synth.PRIME}) % {n})"


def _pick(token: str, values: list[str]) -> str:
    return f"list_extract({sql_list(values)}, ({_draw(token, len(values))} + 1)::INT)"


def _value(token: str, source) -> str:
    if isinstance(source, tuple):
        return f"({_draw(token, source[1] - source[0] + 1)} + {source[0]})::VARCHAR"
    return _pick(token, source)


_START = f"strftime(TIMESTAMP '{_AS_OF}' - to_hours(({_draw('start', 48)} + 1)::BIGINT), '%Y-%m-%d %H:%M UTC')"
_MAP = "map([{keys}], [{values}])".format(
    keys=", ".join(sql_str("{" + t + "}") for t in ["start", *synth.TOKENS]),
    values=", ".join([_START, *[_value(t, s) for t, s in synth.TOKENS.items()]]),
)
_TEMPLATES = ", ".join(
    "(" + ", ".join([sql_str(c), str(i), *[sql_list(synth.pieces(t)) for t in texts]]) + ")"
    for c, variants in synth.TEMPLATES.items()
    for i, texts in enumerate(variants)
)


def _fill(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda p: coalesce(vals[p], p)), '')"


_SEVERITY = (
    f"CASE WHEN category = 'outage' OR contains(description, 'CRITICAL') THEN {_pick('severity', synth.SEVERITY_CHOICES['urgent'])} "
    + " ".join(
        f"WHEN category = '{c}' THEN {_pick('severity', synth.SEVERITY_CHOICES[c])}"
        for c in ["security", "data", "latency", "capacity"]
    )
    + f" ELSE {_pick('severity', synth.OTHER_SEVERITIES)} END"
)

_SQL = f"""WITH seeds AS (SELECT o_orderkey AS seed, {sql_choice(KNOWN_CATEGORIES, 'o_orderkey')} AS category FROM orders),
templates(category, variant, t, d, r) AS (VALUES {_TEMPLATES}),
rows AS (SELECT seed, s.category, t, d, r, {_MAP} AS vals
         FROM seeds s JOIN templates p ON s.category = p.category AND {_draw('template', synth.VARIANTS)} = p.variant),
filled AS (SELECT seed, category, {_fill('t')} AS title, {_fill('d')} AS description, {_fill('r')} AS resolution,
                  TIMESTAMP '{_AS_OF}' - to_days(({_draw('age', 365)} + 1)::INT) AS created_at FROM rows)
SELECT 'syn-' || lpad(lower(to_hex(seed)), 8, '0') AS id, title, description, resolution, category, {_SEVERITY} AS severity,
       epoch_us(created_at) AS created_us,
       epoch_us(created_at + to_minutes(({_draw('repair', 471)} + 10)::BIGINT)) AS resolved_us
FROM filled"""


def generate_incidents(spark, sf_dir):
    seeds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed"))
    made = synth.incidents_from_seeds(seeds, as_of=_AS_OF)
    return made.select(
        "id",
        "title",
        "description",
        "resolution",
        "category",
        "severity",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("resolved_at").alias("resolved_us"),
    )


QUERIES["generate_incidents"] = (generate_incidents, _SQL)
