"""Reading, conforming, filtering, deduplicating and counting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import rules_sql
from checks.tables import (
    DOCUMENT_INCIDENTS,
    EVENT_INCIDENTS,
    RAW_ISSUES,
    SOURCE_OF_LANG,
    choice,
    document_incidents,
    event_incidents,
    raw_issues,
    sql_choice,
    sql_list,
    table,
)
from triagelake.functions.text import embedding_text, query_text
from triagelake.operators import conform, dedupe, filters, issues, profile
from triagelake.schema import CATEGORIES, SEVERITIES, SOURCES
from triagelake.session import scratch_path
from triagelake.sources.incidents import read_incident_dir, read_incidents, write_incidents
from triagelake.sources.titles import TitleTable, add_titles, open_titles, titles_now

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


# --- records -----------------------------------------------------------------

_CATEGORY_VALUES = [*CATEGORIES, "weather", "Latency"]
_SEVERITY_VALUES = [*SEVERITIES, "blocker"]
_SOURCE_VALUES = [*SOURCES, "mail"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.when(key % 41 != 0, F.concat(F.lit("rec-"), key)).alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.when(key % 43 != 0, F.col("o_orderstatus")).alias("description"),
        F.when(key % 5 != 0, choice(_CATEGORY_VALUES, key)).alias("category"),
        F.when(key % 7 != 0, choice(_SEVERITY_VALUES, key)).alias("severity"),
        choice(_SOURCE_VALUES, key).alias("source"),
        F.when(key % 3 != 0, F.when(key % 31 == 0, "soon").otherwise("2024-03-05T06:07:08Z")).alias("created_at"),
        key.alias("row"),
    )


@query(
    "conform_incidents",
    f"""WITH records AS (
  SELECT CASE WHEN o_orderkey % 41 <> 0 THEN 'rec-' || o_orderkey END AS id, o_orderkey AS "row",
         CASE WHEN o_orderkey % 43 <> 0 THEN o_orderstatus END AS description,
         CASE WHEN o_orderkey % 5 <> 0 THEN {sql_choice(_CATEGORY_VALUES, 'o_orderkey')} END AS category,
         CASE WHEN o_orderkey % 7 <> 0 THEN {sql_choice(_SEVERITY_VALUES, 'o_orderkey')} END AS severity,
         {sql_choice(_SOURCE_VALUES, 'o_orderkey')} AS source,
         CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 31 = 0 THEN 'soon' ELSE '2024-03-05 06:07:08' END END AS created
  FROM orders)
SELECT "row", id, coalesce(category, 'unknown') AS category, coalesce(severity, 'unknown') AS severity,
       CASE WHEN created IS NOT NULL THEN epoch_us(try_cast(created AS TIMESTAMP)) END AS created_us,
       concat_ws('; ', CASE WHEN id IS NULL THEN 'missing id' END,
                 CASE WHEN description IS NULL THEN 'missing description' END,
                 CASE WHEN category NOT IN {tuple(CATEGORIES)} THEN 'invalid category: ' || category END,
                 CASE WHEN severity NOT IN {tuple(SEVERITIES)} THEN 'invalid severity: ' || severity END,
                 CASE WHEN source NOT IN {tuple(SOURCES)} THEN 'invalid source: ' || source END,
                 CASE WHEN created IS NOT NULL AND try_cast(created AS TIMESTAMP) IS NULL THEN 'invalid created_at' END) AS problems
FROM records""",
)
def conform_incidents(spark, sf_dir):
    records = _records(spark, sf_dir)
    checked = conform.conform_incidents(records)
    return checked.select(
        "row",
        "id",
        "category",
        "severity",
        F.when(F.col("row") % 3 != 0, F.unix_micros("created_at")).alias("created_us"),
        F.array_join("errors", "; ").alias("problems"),
    )


_REQUESTS = """requests AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 13 = 0 THEN '' WHEN conv_id % 13 = 1 THEN ' ' ELSE text END AS title,
         CASE WHEN conv_id % 17 = 0 THEN repeat(text, 100) ELSE text END AS description,
         (turn * 9 + conv_id) % 25 AS top_k, ((conv_id % 14) - 1) / 10.0 AS threshold
  FROM conversations)"""


def _requests(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 13 == 0, "").when(F.col("conv_id") % 13 == 1, " ").otherwise(F.col("text")).alias("title"),
        F.when(F.col("conv_id") % 17 == 0, F.repeat("text", F.lit(100))).otherwise(F.col("text")).alias("description"),
        ((F.col("turn") * 9 + F.col("conv_id")) % 25).alias("top_k"),
        ((F.col("conv_id") % 14 - 1) / 10.0).alias("threshold"),
    )


@query(
    "validate_analyze_inputs",
    f"""WITH {_REQUESTS}
SELECT conv_id, turn, concat_ws('; ',
  CASE WHEN length(title) NOT BETWEEN 1 AND 500 THEN 'title must be 1 to 500 characters' END,
  CASE WHEN length(description) NOT BETWEEN 1 AND 10000 THEN 'description must be 1 to 10000 characters' END,
  CASE WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k must be 1 to 20' END,
  CASE WHEN threshold NOT BETWEEN 0 AND 1 THEN 'similarity_threshold must be 0.0 to 1.0' END) AS problems
FROM requests""",
)
def validate_analyze_inputs(spark, sf_dir):
    requests = _requests(spark, sf_dir).withColumnRenamed("threshold", "similarity_threshold")
    valid, rejected = conform.validate_inputs(requests, "analyze")
    return valid.select("conv_id", "turn", F.lit("").alias("problems")).unionByName(
        rejected.select("conv_id", "turn", F.array_join("errors", "; ").alias("problems"))
    )


@query(
    "validate_search_inputs",
    f"""WITH {_REQUESTS}
SELECT conv_id, turn, length(description) BETWEEN 1 AND 5000 AND top_k BETWEEN 1 AND 50 AND threshold BETWEEN 0 AND 1 AS accepted
FROM requests""",
)
def validate_search_inputs(spark, sf_dir):
    requests = _requests(spark, sf_dir).drop("title").withColumnRenamed("description", "query")
    valid, rejected = conform.validate_inputs(requests, "search")
    return valid.select("conv_id", "turn", F.lit(True).alias("accepted")).unionByName(
        rejected.select("conv_id", "turn", F.lit(False).alias("accepted"))
    )


# --- projections and filters ---------------------------------------------------


@query(
    "embedding_text",
    f"""WITH {DOCUMENT_INCIDENTS}, texts AS (
  SELECT id, title || ' ' || description || CASE WHEN length(resolution) > 0 THEN ' Resolution: ' || resolution ELSE '' END AS t,
         title || ' ' || description AS q FROM incidents)
SELECT id, length(t)::BIGINT AS chars, md5(t) AS digest, md5(q) AS query_digest FROM texts""",
)
def embedding_texts(spark, sf_dir):
    return document_incidents(spark, sf_dir).select(
        "id",
        F.length(embedding_text()).cast("bigint").alias("chars"),
        F.md5(embedding_text()).alias("digest"),
        F.md5(query_text()).alias("query_digest"),
    )


# name -> filters, and the same as SQL
_FILTERS = {
    "one_category": (dict(categories=["latency"]), "category = 'latency'"),
    "two_categories": (dict(categories=["latency", "outage"]), "category IN ('latency', 'outage')"),
    "severities": (dict(severities=["critical", "high"]), "severity IN ('critical', 'high')"),
    "from_date": (dict(after="2024-01-10"), "created_at >= TIMESTAMP '2024-01-10'"),
    "to_date": (dict(before="2024-01-05"), "created_at <= TIMESTAMP '2024-01-05'"),
    "range": (
        dict(after="2024-01-02T06:10:00", before="2024-01-20"),
        "created_at BETWEEN TIMESTAMP '2024-01-02 06:10:00' AND TIMESTAMP '2024-01-20'",
    ),
    "all_kinds": (
        dict(categories=["data", "security"], severities=["low", "medium"], after="2024-01-03", before="2024-01-25"),
        "category IN ('data', 'security') AND severity IN ('low', 'medium') "
        "AND created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'",
    ),
    "empty_list": (dict(categories=[]), "false"),
    "none": (dict(), "true"),
}


@query(
    "filter_incidents",
    f"WITH {DOCUMENT_INCIDENTS} "
    + " UNION ALL ".join(f"SELECT '{name}' AS filter, id FROM incidents WHERE {sql}" for name, (_, sql) in _FILTERS.items()),
)
def filter_incidents(spark, sf_dir):
    """All filters over one scan: every incident with the names of those it meets."""
    incidents = document_incidents(spark, sf_dir)
    met = [
        F.when(F.lit(True) if (test := filters.incident_predicate(**kw)) is None else test, F.lit(name))
        for name, (kw, _) in _FILTERS.items()
    ]
    return incidents.select(F.explode(F.array_compact(F.array(*met))).alias("filter"), "id")


@query(
    "filter_ids_by_event",
    f"""WITH {EVENT_INCIDENTS}
SELECT DISTINCT id FROM incidents WHERE category IN ('outage', 'data') AND severity = 'critical'
  AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""",
)
def filter_ids_by_event(spark, sf_dir):
    return filters.filter_ids(
        event_incidents(spark, sf_dir),
        categories=["outage", "data"],
        severities=["critical"],
        after="2024-01-05",
        before="2024-01-12",
    )


@query(
    "id_set_operations",
    f"""WITH {DOCUMENT_INCIDENTS},
a AS (SELECT id FROM incidents WHERE category = 'latency'), b AS (SELECT id FROM incidents WHERE category = 'outage'),
c AS (SELECT id FROM incidents WHERE severity IN ('critical', 'low'))
SELECT id FROM (SELECT id FROM a UNION SELECT id FROM b) INTERSECT SELECT id FROM c""",
)
def id_set_operations(spark, sf_dir):
    incidents = document_incidents(spark, sf_dir)
    either = filters.union_ids(
        filters.filter_ids(incidents, categories=["latency"]), filters.filter_ids(incidents, categories=["outage"])
    )
    return filters.intersect_ids(either, filters.filter_ids(incidents, severities=["critical", "low"]))


@query(
    "lookup_by_id",
    f"""WITH {DOCUMENT_INCIDENTS}
SELECT id, title, category, severity FROM incidents WHERE id IN (SELECT 'doc-' || doc_id FROM labels WHERE toxic = 1)""",
)
def lookup_by_id(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"))
    return filters.lookup(document_incidents(spark, sf_dir), wanted).select("id", "title", "category", "severity")


@query(
    "sorted_by_time",
    f"""WITH {EVENT_INCIDENTS}
SELECT id, event_id, epoch_us(created_at) AS created_us FROM incidents ORDER BY created_at, id""",
)
def sorted_by_time(spark, sf_dir):
    return filters.by_time(event_incidents(spark, sf_dir)).select("id", "event_id", F.unix_micros("created_at").alias("created_us"))


# --- deduplication and union -----------------------------------------------------

_KEY = "lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g'))"


@query(
    "latest_by_id",
    f"""WITH {EVENT_INCIDENTS}
SELECT id, event_id, category, severity FROM incidents
QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1""",
)
def latest_by_id(spark, sf_dir):
    return dedupe.latest_by_id(event_incidents(spark, sf_dir), ["event_id"]).select("id", "event_id", "category", "severity")


@query(
    "dedupe_titles",
    f"""WITH {DOCUMENT_INCIDENTS}
SELECT id, title, md5(description) AS digest FROM incidents
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY created_at, id) = 1""",
)
def dedupe_titles(spark, sf_dir):
    return dedupe.dedupe_titles(document_incidents(spark, sf_dir)).select("id", "title", F.md5("description").alias("digest"))


@query(
    "dedupe_titles_by_increments",
    f"""WITH {DOCUMENT_INCIDENTS}
SELECT id, title, md5(description) AS digest FROM incidents
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY created_at, id) = 1""",
)
def dedupe_titles_by_increments(spark, sf_dir):
    """Three increments out of order of time, so that later ones overtake stored titles."""
    incidents = document_incidents(spark, sf_dir)
    kept = TitleTable(f"titles_{uuid.uuid4().hex}", scratch_path(spark, "titles"), buckets=8)
    open_titles(spark, kept, incidents.schema)
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3))
    for n in (2, 0, 1):
        add_titles(spark, kept, incidents.where(part == n))
    return titles_now(spark, kept).select("id", "title", F.md5("description").alias("digest"))


@query(
    "dedupe_titles_of_events",
    f"""WITH {EVENT_INCIDENTS}
SELECT id, event_id, title FROM incidents
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY event_id) = 1""",
)
def dedupe_titles_of_events(spark, sf_dir):
    """Five titles over the whole table: the most skewed case there is."""
    return dedupe.dedupe_titles(event_incidents(spark, sf_dir), [F.col("event_id")]).select("id", "event_id", "title")


@query(
    "combine_sources",
    f"""WITH {DOCUMENT_INCIDENTS}, ranked AS (
  SELECT *, CASE source WHEN 'synthetic' THEN 0 WHEN 'github' THEN 1 ELSE 2 END AS source_rank FROM incidents)
SELECT id, source, title FROM ranked
QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY source_rank, created_at, id) = 1""",
)
def combine_sources(spark, sf_dir):
    incidents = document_incidents(spark, sf_dir)
    rest = incidents.filter(~F.col("source").isin("synthetic", "github"))
    parts = [(0, incidents.filter("source = 'synthetic'")), (1, incidents.filter("source = 'github'")), (2, rest)]
    return dedupe.combine_sources(parts).select("id", "source", "title")


# --- counts ----------------------------------------------------------------------

_STATS = """SELECT dimension, value, incidents, with_resolution, with_resolution / incidents AS resolution_rate FROM (
  SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity'
              WHEN grouping(source) = 0 THEN 'source' ELSE 'total' END AS dimension,
         coalesce(category, severity, source, 'all') AS value, count(*) AS incidents,
         count(*) FILTER (length(resolution) > 0) AS with_resolution
  FROM {table} GROUP BY GROUPING SETS ((category), (severity), (source), ()))"""


@query("incident_stats", f"WITH {DOCUMENT_INCIDENTS} " + _STATS.format(table="incidents"))
def incident_stats(spark, sf_dir):
    return profile.incident_stats(document_incidents(spark, sf_dir))


@query(
    "incident_stats_after_id_dedupe",
    f"""WITH {EVENT_INCIDENTS}, latest AS (
  SELECT * FROM incidents QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1) """
    + _STATS.format(table="latest"),
)
def incident_stats_after_id_dedupe(spark, sf_dir):
    return profile.incident_stats(dedupe.latest_by_id(event_incidents(spark, sf_dir), ["event_id"]))


@query(
    "class_distribution",
    f"""WITH {DOCUMENT_INCIDENTS}
SELECT category, count(*) AS incidents FROM incidents WHERE category <> 'unknown' GROUP BY category ORDER BY category""",
)
def class_distribution(spark, sf_dir):
    return profile.class_distribution(document_incidents(spark, sf_dir))


# --- files -----------------------------------------------------------------------


@query("json_files_round_trip", f"WITH {DOCUMENT_INCIDENTS} " + _STATS.format(table="incidents"))
def json_files_round_trip(spark, sf_dir):
    """Write the incidents as JSON lines, read them back through the checks, count."""
    path = scratch_path(spark, "incidents-json")
    write_incidents(document_incidents(spark, sf_dir), path, "json")
    valid, _ = read_incidents(spark, path)
    return profile.incident_stats(valid)


@query(
    "incident_table_round_trip",
    f"""WITH {DOCUMENT_INCIDENTS}
SELECT id, md5(description) AS digest, epoch_us(created_at) AS created_us FROM incidents
WHERE category = 'data' AND created_at >= TIMESTAMP '2024-01-02'""",
)
def incident_table_round_trip(spark, sf_dir):
    """Write the partitioned table; read one category from a date on."""
    path = scratch_path(spark, "incidents-table")
    write_incidents(document_incidents(spark, sf_dir), path)
    found = filters.filter_incidents(spark.read.parquet(path), categories=["data"], after="2024-01-02")
    return found.select("id", F.md5("description").alias("digest"), F.unix_micros("created_at").alias("created_us"))


@query(
    "incident_dir_by_source",
    f"WITH {DOCUMENT_INCIDENTS} SELECT source, count(*) AS incidents, count(DISTINCT id) AS ids FROM incidents GROUP BY source",
)
def incident_dir_by_source(spark, sf_dir):
    """A folder of several sets of files, read by one pattern."""
    root = scratch_path(spark, "incidents-dir")
    incidents = document_incidents(spark, sf_dir)
    for source in sorted({*SOURCE_OF_LANG.values(), "manual"}):
        write_incidents(incidents.filter(F.col("source") == source), f"{root}/from={source}", "json")
    valid, _ = read_incident_dir(spark, root, pattern="*.json")
    return valid.groupBy("source").agg(F.count("*").alias("incidents"), F.count_distinct("id").alias("ids"))


# --- issues ----------------------------------------------------------------------

_ISSUE_TEXT = "title || ' ' || coalesce(body, '')"
_LOWER_LABELS = "list_transform(labels, lambda x: lower(x))"
_RESOLUTION = (
    "CASE WHEN state = 'closed' THEN 'Referenced: ' || coalesce("
    "nullif(regexp_extract(body, '(?i)(?:fixed|resolved|closed) (?:by|in|via) #(\\d+)'), ''), "
    "nullif(regexp_extract(body, '(?i)(?:root cause|solution|fix):\\s*(.+?)(?:\\n|$)'), '')) END"
)

_ISSUE_CTES = ", ".join(
    [
        RAW_ISSUES,
        rules_sql.label_category("issues", "id"),
        rules_sql.keyword_scores("issues", "id", _ISSUE_TEXT),
    ]
)


@query(
    "issues_to_incidents",
    f"""WITH {_ISSUE_CTES}
SELECT 'gh-' || replace(repo, '/', '-') || '-' || number AS id, title, body AS description,
       CASE WHEN l.category <> 'unknown' THEN l.category ELSE t.category END AS category,
       {rules_sql.issue_severity_case(f'lower({_ISSUE_TEXT})', _LOWER_LABELS)} AS severity,
       epoch_us(created_at) AS created_us, epoch_us(closed_at) AS resolved_us, {_RESOLUTION} AS resolution,
       array_to_string(labels, '|') AS label_names,
       '{{"repo":"' || repo || '","issue_number":' || number || ',"url":"' || html_url || '","state":"' || state
         || '","author":"' || login || '","comments_count":' || coalesce(comments, 0) || '}}' AS metadata
FROM issues JOIN by_label l USING (id) JOIN by_text t USING (id)
WHERE NOT is_pull AND length(body) > 0""",
)
def issues_to_incidents(spark, sf_dir):
    kept = issues.drop_pull_requests(raw_issues(spark, sf_dir))
    incidents = issues.drop_empty_description(issues.issues_to_incidents(kept))
    return incidents.select(
        "id",
        "title",
        "description",
        "category",
        "severity",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("resolved_at").alias("resolved_us"),
        "resolution",
        F.array_join("labels", "|").alias("label_names"),
        "metadata",
    )


_QUOTA_CTES = f"""{RAW_ISSUES},
wanted(name, place) AS (VALUES ('bug', 0), ('performance', 1), ('crash', 2), ('outage', 3), ('incident', 4)),
labelled AS (SELECT DISTINCT id, repo, updated_at, place FROM (
    SELECT id, repo, updated_at, unnest(labels) AS label FROM issues WHERE NOT is_pull) JOIN wanted ON label = name),
picked AS (
  SELECT repo, id, place AS branch_rank FROM labelled
  QUALIFY row_number() OVER (PARTITION BY repo, place ORDER BY updated_at DESC, id) <= 10
  UNION ALL
  SELECT repo, id, 5 AS branch_rank FROM issues WHERE NOT is_pull AND state = 'closed'
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, id) <= 25)"""


@query("issue_quota", f"WITH {_QUOTA_CTES} SELECT repo, id, branch_rank FROM picked")
def issue_quota(spark, sf_dir):
    return issues.issue_quota(raw_issues(spark, sf_dir)).select("repo", "id", "branch_rank")


@query(
    "collect_incidents",
    f"""WITH {_QUOTA_CTES}
SELECT DISTINCT 'gh-' || replace(repo, '/', '-') || '-' || number AS id, title
FROM issues JOIN picked USING (repo, id) WHERE length(body) > 0""",
)
def collect_incidents(spark, sf_dir):
    return issues.collect_incidents(raw_issues(spark, sf_dir)).select("id", "title")
