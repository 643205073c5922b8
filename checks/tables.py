"""The driver's tables seen as incidents, issues, requests and answers.

Every view exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.schema import CATEGORIES, KNOWN_CATEGORIES, SEVERITIES

EPOCH_2024 = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def sql_choice(values: list[str], index: str) -> str:
    return f"list_extract({sql_list(values)}, (({index}) % {len(values)} + 1)::INT)"


# --- documents as incidents --------------------------------------------------

SOURCE_OF_LANG = {"en": "github", "fr": "synthetic", "de": "kaggle"}


def document_incidents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as incidents; ``more`` names columns of the documents to keep."""
    docs = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 37 * 60)
    source = F.lit("manual")
    for lang, name in SOURCE_OF_LANG.items():
        source = F.when(F.col("lang") == lang, F.lit(name)).otherwise(source)
    resolution = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("Checked by "), F.col("source"))).when(
        F.col("n_chars") % 3 == 1, F.lit("")
    )
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
        choice(CATEGORIES, F.col("doc_id")).alias("category"),
        choice(SEVERITIES, F.col("n_chars")).alias("severity"),
        source.alias("source"),
        created.alias("created_at"),
        F.when(F.col("n_chars") % 3 == 0, created + F.make_dt_interval(mins=F.col("n_chars").cast("int"))).alias(
            "resolved_at"
        ),
        resolution.alias("resolution"),
        F.array("lang", "source").alias("labels"),
        F.lit("{}").alias("metadata"),
        *more,
    )


DOCUMENT_INCIDENTS = f"""incidents AS (
  SELECT 'doc-' || doc_id AS id,
         split_part(text, chr(10), 1) AS title,
         text AS description,
         {sql_choice(CATEGORIES, 'doc_id')} AS category,
         {sql_choice(SEVERITIES, 'n_chars')} AS severity,
         CASE lang WHEN 'en' THEN 'github' WHEN 'fr' THEN 'synthetic' WHEN 'de' THEN 'kaggle' ELSE 'manual' END AS source,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS created_at,
         CASE WHEN n_chars % 3 = 0 THEN 'Checked by ' || source WHEN n_chars % 3 = 1 THEN '' END AS resolution
  FROM documents)"""


# --- events as versions of incidents -----------------------------------------

EVENT_CATEGORY = {
    "view": "latency", "error": "outage", "click": "config", "signup": "security", "purchase": "data",
}


def event_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident id per user, a version of it per event."""
    events = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_CATEGORY.items() for x in pair])
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("id"),
        F.concat(F.lit("  "), F.upper("event_type"), F.lit("\t")).alias("title"),
        F.col("props").alias("description"),
        F.element_at(kinds, F.col("event_type")).alias("category"),
        F.when(F.col("value") > 50, "critical").when(F.col("value") > 20, "high").otherwise("low").alias("severity"),
        F.lit("manual").alias("source"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp").alias("created_at"),
        F.col("props").alias("metadata"),
        F.lit(None).cast("string").alias("resolution"),
        "event_id",
    )


EVENT_INCIDENTS = """incidents AS (
  SELECT 'user-' || user_id AS id, '  ' || upper(event_type) || chr(9) AS title, props AS description,
         CASE event_type WHEN 'view' THEN 'latency' WHEN 'error' THEN 'outage' WHEN 'click' THEN 'config'
              WHEN 'signup' THEN 'security' WHEN 'purchase' THEN 'data' END AS category,
         CASE WHEN value > 50 THEN 'critical' WHEN value > 20 THEN 'high' ELSE 'low' END AS severity,
         'manual' AS source, ts AS created_at, CAST(NULL AS VARCHAR) AS resolution, event_id
  FROM events)"""


# --- orders as labelled records ----------------------------------------------

LABEL_SETS = [
    ["performance"],
    ["Bug", "low"],
    ["area/networking"],
    [],
    ["a"],
    [""],
    ["enhancement", "performance", "bug"],
    ["unknown-label", "random"],
    ["priority/critical", "storage"],
    ["data-loss", "slow"],
    ["P1", "SECURITY"],
    ["kind/config", "minor"],
    ["outage", "crash", "P2"],
]

PHRASES = [
    "nothing special",
    "a complete outage for all users",
    "Production DOWN since noon",
    "degraded, some users",
    "a typo only",
    "this is an important regression",
    "we follow the allowed path",
]

BODIES = [
    "Closed VIA #12 and done",
    "Root cause: bad disk\nmore text",
    "service answers 503, not responding",
    "",
    None,
    "dns lookups fail on the load balancer, tcp port closed",
    "Solution:   \n\nadd an index to the database",
]


def label_sets() -> Column:
    sets = F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in LABEL_SETS])
    return F.element_at(sets, (F.col("o_orderkey") % len(LABEL_SETS) + 1).cast("int"))


LABEL_SETS_SQL = (
    "list_extract([" + ", ".join(f"{sql_list(s)}::VARCHAR[]" for s in LABEL_SETS) + f"], (o_orderkey % {len(LABEL_SETS)} + 1)::INT)"
)


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    closed = F.col("o_orderstatus") == "F"
    return orders.select(
        key.alias("id"),
        (key + 1000).alias("number"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), choice(PHRASES, key)).alias("title"),
        choice(BODIES, key + F.col("o_custkey")).alias("body"),
        F.transform(label_sets(), lambda x: F.struct(x.alias("name"))).alias("labels"),
        F.when(closed, "closed").otherwise("open").alias("state"),
        F.concat(F.lit("https://issues.invalid/"), key).alias("html_url"),
        F.struct(F.concat(F.lit("user"), F.col("o_custkey")).alias("login")).alias("user"),
        F.when(key % 4 != 0, key % 17).alias("comments"),
        F.concat(day, F.lit("T08:30:00Z")).alias("created_at"),
        F.concat(day, F.lit("T10:00:00Z")).alias("updated_at"),
        F.when(closed, F.concat(day, F.lit("T12:15:00Z"))).alias("closed_at"),
        F.when(key % 11 == 0, F.struct(F.lit("https://issues.invalid/pull").alias("url"))).alias("pull_request"),
        F.concat(F.lit("org"), F.col("o_custkey") % 5, F.lit("/app")).alias("repo"),
    )


_BODY_SQL = (
    "list_extract([" + ", ".join("NULL" if b is None else sql_str(b).replace("\n", "' || chr(10) || '") for b in BODIES)
    + f"], ((o_orderkey + o_custkey) % {len(BODIES)} + 1)::INT)"
)

RAW_ISSUES = f"""issues AS (
  SELECT o_orderkey AS id, o_orderkey + 1000 AS number,
         o_orderpriority || ' ' || {sql_choice(PHRASES, 'o_orderkey')} AS title,
         {_BODY_SQL} AS body,
         {LABEL_SETS_SQL} AS labels,
         CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
         'https://issues.invalid/' || o_orderkey AS html_url,
         'user' || o_custkey AS login,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 17 END AS comments,
         o_orderdate + INTERVAL 510 MINUTE AS created_at,
         o_orderdate + INTERVAL 600 MINUTE AS updated_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 735 MINUTE END AS closed_at,
         o_orderkey % 11 = 0 AS is_pull,
         'org' || (o_custkey % 5) || '/app' AS repo
  FROM orders)"""


# --- orders as model answers -------------------------------------------------

ANSWERS = [
    '{"root_cause_hypothesis":"disk @","recommended_actions":["check @","restart"],"estimated_impact":"some","analysis_summary":"sum @","citations":[{"incident_id":"doc-@","text":"t","relevance":"r"}]}',
    'Here you go:\n```json\n{"root_cause_hypothesis":"net @","recommended_actions":["x"],"estimated_impact":"i","analysis_summary":"s","citations":[1,"a",{"text":"only text"},{}]}\n```\nanything else?',
    '```\n{"root_cause_hypothesis":"fenced @","recommended_actions":[],"estimated_impact":"i","analysis_summary":"s"}\n```',
    "I cannot answer that.",
    '{"recommended_actions":["x"],"estimated_impact":"i","analysis_summary":"s"}',
    '{"root_cause_hypothesis":"h","recommended_actions":"not a list","estimated_impact":"i","analysis_summary":"s"}',
    '{"root_cause_hypothesis":"h","recommended_actions":["valid",123],"estimated_impact":"i","analysis_summary":"s"}',
    '{"root_cause_hypothesis":@,"recommended_actions":[null],"estimated_impact":null,"analysis_summary":{"a":1}}',
    '```json\n{"root_cause_hypothesis":"open fence @","recommended_actions":["a"],"estimated_impact":"i","analysis_summary":"s","citations":[]}',
    '{"root_cause_hypothesis":"broken @","recommended_actions":["a"',
    '{"root_cause_hypothesis":true,"recommended_actions":[1.5],"estimated_impact":2.5,"analysis_summary":"s"}',
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.replace(choice(ANSWERS, F.col("o_orderkey")), F.lit("@"), F.col("o_custkey").cast("string"))
    text = F.when(F.col("o_orderkey") % 23 != 0, text)
    return orders.select(F.col("o_orderkey").alias("query_id"), text.alias("response"))


_ANSWERS_SQL = "[" + ", ".join(sql_str(a).replace("\n", "' || chr(10) || '") for a in ANSWERS) + "]"

ANSWERS_CTE = f"""answers AS (
  SELECT o_orderkey AS query_id,
         CASE WHEN o_orderkey % 23 <> 0 THEN
           replace(list_extract({_ANSWERS_SQL}, (o_orderkey % {len(ANSWERS)} + 1)::INT), '@', o_custkey::VARCHAR) END AS response
  FROM orders),
parts AS (
  SELECT query_id, response,
         CASE WHEN contains(response, '```json') THEN split_part(substring(response, strpos(response, '```json') + 7), '```', 1)
              WHEN contains(response, '```') THEN split_part(substring(response, strpos(response, '```') + 3), '```', 1)
              ELSE response END AS body
  FROM answers),
found AS (
  SELECT query_id, response,
         CASE WHEN strpos(body, '{{') > 0 AND strpos(body, '}}') > 0
              THEN substring(body, strpos(body, '{{'),
                             length(body) - strpos(reverse(body), '}}') - strpos(body, '{{') + 2) END AS text
  FROM parts),
objects AS (
  SELECT query_id, response, CASE WHEN json_valid(text) THEN text END AS j FROM found)"""


# --- orders as predictions ---------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    actual = choice(KNOWN_CATEGORIES, F.col("o_custkey"))
    guess = choice(KNOWN_CATEGORIES, F.col("o_orderkey") * 7 + F.col("o_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("id"),
        actual.alias("actual"),
        F.when(F.col("o_orderkey") % 10 < 6, actual).otherwise(guess).alias("predicted"),
    )


PREDICTIONS = f"""predictions AS (
  SELECT id, actual, CASE WHEN id % 10 < 6 THEN actual ELSE guess END AS predicted FROM (
    SELECT o_orderkey AS id, {sql_choice(KNOWN_CATEGORIES, 'o_custkey')} AS actual,
           {sql_choice(KNOWN_CATEGORIES, 'o_orderkey * 7 + o_custkey')} AS guess
    FROM orders))"""


# --- embeddings --------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per document id; the vector label stands for nothing here."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.concat(F.lit("doc-"), F.col("vec_id")).alias("id"), F.col("embedding").alias("vec"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


# Compared as they are; rounded where they are shown.
SHOWN = "round(score, 6)"
SCORES = """scores AS (
  SELECT q.vec_id AS query_id, 'doc-' || c.vec_id AS incident_id, c.vec_id,
         list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings c)"""
