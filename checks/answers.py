"""Prompts, model answers, whole analyses and their evaluation."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from checks import rules_sql
from checks.tables import (
    ANSWERS_CTE,
    DOCUMENT_INCIDENTS,
    SCORES,
    answers,
    choice,
    corpus,
    document_incidents,
    sql_choice,
    sql_str,
    table,
    vector_queries,
)
from triagelake.functions.responses import (
    extract_json,
    json_text,
    parse_citations,
    validate_response,
)
from triagelake.functions.text import two_decimals
from triagelake.operators import evaluation, generation, prompts, similarity
from triagelake.operators.classify import classify
from triagelake.plans.analyze import analyze
from triagelake.schema import KNOWN_CATEGORIES, SEVERITIES

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


# --- prompts -------------------------------------------------------------------

PROMPT_TEMPLATE = "T {title} ({category}, {severity})\n{description}\n{{past}}\n{similar_incidents}\nend"

_HITS = f"""{SCORES},
ranked AS (SELECT query_id, incident_id, least(greatest(round(score, 6), 0), 1) AS score,
                  row_number() OVER (PARTITION BY query_id ORDER BY scores.score DESC, incident_id) AS rank
           FROM scores QUALIFY rank <= 3 AND scores.score >= 0.3),
found AS (SELECT * FROM ranked JOIN incidents ON incident_id = id),
blocks AS (
  SELECT query_id, string_agg(
    chr(10) || '### Similar Incident ' || rank || ' (Similarity: ' || printf('%.2f', score::DOUBLE) || ')' || chr(10)
    || '- ID: ' || incident_id || chr(10) || '- Title: ' || title || chr(10) || '- Category: ' || category || chr(10)
    || '- Severity: ' || severity || chr(10) || '- Description: ' || substring(description, 1, 500) || '...' || chr(10)
    || '- Resolution: ' || coalesce(nullif(resolution, ''), 'Not resolved yet') || chr(10), chr(10) ORDER BY rank) AS similar_incidents
  FROM found GROUP BY query_id)"""


def _found(spark, sf_dir):
    others = similarity.topk_similar(vector_queries(spark, sf_dir), corpus(spark, sf_dir), 3, 0.3)
    return similarity.attach_incidents(others, document_incidents(spark, sf_dir))


@query(
    "format_similar",
    f"WITH {DOCUMENT_INCIDENTS}, {_HITS} SELECT query_id, similar_incidents FROM blocks",
)
def format_similar(spark, sf_dir):
    return prompts.format_similar(_found(spark, sf_dir))


_PROMPT_QUERIES = f"""{DOCUMENT_INCIDENTS},
{rules_sql.keyword_scores('incidents', 'id', "title || ' ' || description")},
asked AS (SELECT i.id, substring(i.id, 5)::BIGINT AS query_id, title, description, t.category AS predicted_category,
                 {rules_sql.severity_case("lower(title || ' ' || description)")} AS predicted_severity
          FROM incidents i JOIN by_text t USING (id))"""


@query(
    "build_prompts",
    f"""WITH {_PROMPT_QUERIES}, {_HITS}
SELECT query_id, md5('T ' || title || ' (' || predicted_category || ', ' || predicted_severity || ')' || chr(10) || description
  || chr(10) || '{{past}}' || chr(10) || coalesce(similar_incidents, 'No similar incidents found.') || chr(10) || 'end') AS digest
FROM asked LEFT JOIN blocks USING (query_id)""",
)
def build_prompts(spark, sf_dir):
    """Every document asks; those without a vector have no similar incidents."""
    asked = classify(document_incidents(spark, sf_dir)).withColumn(
        "query_id", F.substring("id", 5, 20).cast("bigint")
    )
    built = prompts.build_prompts(asked, _found(spark, sf_dir), PROMPT_TEMPLATE)
    return built.select("query_id", F.md5("prompt").alias("digest"))


@query(
    "feedback",
    """SELECT conv_id, turn, text || CASE WHEN turn > 0 THEN chr(10) || chr(10) || 'Previous attempt failed validation: ' || role
  || chr(10) || 'Please fix the issue and provide a valid JSON response.' ELSE '' END AS prompt FROM conversations""",
)
def feedback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    error = F.when(F.col("turn") > 0, F.col("role"))
    return turns.select("conv_id", "turn", prompts.with_feedback(F.col("text"), error).alias("prompt"))


@query(
    "two_decimals",
    "SELECT event_id, printf('%.2f', least(value / 400, 1)::DOUBLE) AS shown FROM events",
)
def shown_scores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", two_decimals(F.col("value") / 400).alias("shown"))


# --- answers -------------------------------------------------------------------

_FIELDS = [
    ("root_cause_hypothesis", "str"), ("recommended_actions", "list"),
    ("estimated_impact", "str"), ("analysis_summary", "str"),
]


def _type_sql(field: str) -> str:
    return (
        f"CASE json_type(j, '$.{field}') WHEN 'VARCHAR' THEN 'str' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' "
        "WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' "
        "WHEN 'DOUBLE' THEN 'float' END"
    )


_PROBLEMS = ", ".join(
    f"CASE WHEN {_type_sql(f)} IS NULL THEN 'Missing required field: {f}' "
    f"WHEN {_type_sql(f)} <> '{t}' THEN 'Field ''{f}'' expected {t}, got ' || {_type_sql(f)} END"
    for f, t in _FIELDS
)

_VERDICTS = f"""{ANSWERS_CTE},
verdicts AS (
  SELECT query_id, j, CASE WHEN j IS NULL THEN 'LLM response is None' ELSE nullif(concat_ws('; ', {_PROBLEMS},
    CASE WHEN json_type(j, '$.recommended_actions') = 'ARRAY'
          AND len(list_filter(json_extract(j, '$.recommended_actions[*]'), lambda a: json_type(a) <> 'VARCHAR')) > 0
         THEN 'All items in ''recommended_actions'' must be strings' END), '') END AS error
  FROM objects)"""


@query("extract_json", f"WITH {ANSWERS_CTE} SELECT query_id, j IS NOT NULL AS is_object, j AS text FROM objects")
def extracted(spark, sf_dir):
    replies = answers(spark, sf_dir)
    ok = extract_json("response").isNotNull()
    return replies.select("query_id", ok.alias("is_object"), F.when(ok, json_text("response")).alias("text"))


@query("validate_response", f"WITH {_VERDICTS} SELECT query_id, error IS NULL AS passed, error FROM verdicts")
def validated(spark, sf_dir):
    parsed = answers(spark, sf_dir).select("query_id", extract_json("response").alias("a"))
    return parsed.select("query_id", validate_response("a").alias("v")).select("query_id", "v.passed", "v.error")


_CITATIONS = f"""{ANSWERS_CTE},
items AS (SELECT query_id, unnest(json_extract(j, '$.citations[*]')) AS c,
                 generate_subscripts(json_extract(j, '$.citations[*]'), 1) AS pos FROM objects),
citations AS (SELECT query_id, pos, coalesce(json_extract_string(c, '$.incident_id'), 'unknown') AS incident_id,
                     coalesce(json_extract_string(c, '$.text'), '') AS text,
                     coalesce(json_extract_string(c, '$.relevance'), '') AS relevance
              FROM items WHERE json_type(c) = 'OBJECT')"""


@query(
    "parse_citations",
    f"""WITH {_CITATIONS}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS place, incident_id, text, relevance FROM citations""",
)
def citations(spark, sf_dir):
    listed = answers(spark, sf_dir).select("query_id", F.posexplode(parse_citations(extract_json("response"))).alias("place", "c"))
    return listed.select("query_id", F.col("place").cast("bigint").alias("place"), "c.*")


@query(
    "build_results",
    f"""WITH {_VERDICTS}
SELECT query_id, error IS NULL AS passed,
       CASE WHEN error IS NULL THEN json_extract_string(j, '$.root_cause_hypothesis')
            ELSE 'Unable to generate analysis: ' || error END AS root_cause,
       CASE WHEN error IS NULL THEN array_to_string(json_extract_string(j, '$.recommended_actions[*]'), '|')
            ELSE 'Investigate manually|Check logs|Review recent changes' END AS actions,
       CASE WHEN error IS NULL THEN json_extract_string(j, '$.estimated_impact') ELSE 'Unknown - requires manual assessment' END AS impact,
       CASE WHEN error IS NULL THEN json_extract_string(j, '$.analysis_summary') ELSE 'LLM analysis unavailable' END AS summary,
       CASE WHEN error IS NULL THEN j END AS raw
FROM verdicts""",
)
def built_results(spark, sf_dir):
    checked = generation.check_answers(answers(spark, sf_dir))
    return generation.results(checked).select(
        "query_id",
        "passed",
        F.col("root_cause_hypothesis").alias("root_cause"),
        F.array_join("recommended_actions", "|").alias("actions"),
        F.col("estimated_impact").alias("impact"),
        F.col("analysis_summary").alias("summary"),
        F.col("raw_llm_response").alias("raw"),
    )


# --- asking a model ------------------------------------------------------------

_GOOD = (
    '{"root_cause_hypothesis":"seen before","recommended_actions":["look"],"estimated_impact":"some",'
    '"analysis_summary":"short","citations":[{"incident_id":"x"}]}'
)


def _reply(text: str, kind: int) -> str:
    """Answers well, at the second try, badly, or not at all."""
    if kind == 0:
        return _GOOD
    if kind == 1:
        return _GOOD if "\n\nPrevious attempt failed validation:" in text else "no"
    if kind == 2:
        return '{"recommended_actions": []}'
    raise ValueError("model is busy")


def stand_in(texts):
    """A model whose mood follows from the length of what it is asked."""
    asked = [t.split("\n\nPrevious attempt failed validation:")[0] for t in texts]
    return [_reply_or_error(t, len(a) % 4) for t, a in zip(texts, asked)]


def stand_in_by_title(texts):
    """The same for whole prompts, by the title in them."""
    titles = [t.split("\nTitle: ", 1)[1].split("\nDescription: ", 1)[0] for t in texts]
    return [_reply_or_error(t, len(title) % 4) for t, title in zip(texts, titles)]


_FIELDS_MISSING = (
    "Missing required field: root_cause_hypothesis; Missing required field: estimated_impact; "
    "Missing required field: analysis_summary"
)


def outcome_sql(title: str) -> dict[str, str]:
    """What an analysis with `stand_in_by_title` comes to."""
    kind = f"length({title}) % 4"
    return {
        "attempts": f"CASE {kind} WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END",
        "root_cause": f"CASE {kind} WHEN 2 THEN 'Unable to generate analysis: {_FIELDS_MISSING}' "
        f"WHEN 3 THEN 'Unable to generate analysis: LLM response is None' ELSE 'seen before' END",
        "citations": f"CASE WHEN {kind} < 2 THEN 1 ELSE 0 END",
    }


ROUNDS_SQL = (
    """WITH asked AS (SELECT conv_id * 100 + turn AS query_id, length(text) % 4 AS kind FROM conversations)
SELECT query_id, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts, kind < 2 AS passed,
       CASE kind WHEN 2 THEN '""" + _FIELDS_MISSING + """'
                 WHEN 3 THEN 'LLM response is None' END AS generation_error,
       CASE WHEN kind = 3 THEN 'model is busy' END AS response_error
FROM asked"""
)


@query("generation_rounds", ROUNDS_SQL)
def generation_rounds(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"))
    done = generation.generation_rounds(asked, stand_in)
    return done.select("query_id", "attempts", "passed", "generation_error", "response_error")


_ANALYZED = outcome_sql("title")


def echo_by_title(texts, system=None):
    """`stand_in_by_title`, with a digest of what it was asked, so that prompts can be compared."""
    if not system:
        raise ValueError("no system prompt")
    asked = [t.split("\n\nPrevious attempt failed validation:")[0] for t in texts]
    titles = [a.split("T ", 1)[1].split(" (", 1)[0] for a in asked]
    answers = [_reply_or_error(t, len(title) % 4) for t, title in zip(texts, titles, strict=True)]
    return [
        r if isinstance(r, Exception) else r.replace('"short"', '"' + hashlib.md5(a.encode()).hexdigest() + '"')
        for r, a in zip(answers, asked, strict=True)
    ]


def _reply_or_error(text: str, kind: int):
    return ValueError("model is busy") if kind == 3 else _reply(text, kind)


# A turn asks with the vector of the row its number points to, on its own terms.
ASKED = """asked AS (SELECT conv_id * 100 + turn AS query_id, role || repeat('!', (turn % 4)::INT) AS title, text AS description,
  (conv_id * 100 + turn) % (SELECT count(*) FROM embeddings) AS vec_id, (conv_id + turn) % 4 + 1 AS k, ((conv_id + turn) % 5) / 10.0 AS least, conv_id FROM conversations)"""

RELAXED = f"""{SCORES},
ranked AS (SELECT a.query_id, incident_id, score, k, least,
    row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, incident_id) AS rank
  FROM asked a JOIN scores s ON s.query_id = a.vec_id),
wide AS (SELECT *, count(*) FILTER (rank <= k AND score >= least) OVER (PARTITION BY query_id) < 2 AS weak FROM ranked),
chosen AS (SELECT query_id, incident_id, least(greatest(round(score, 6), 0), 1) AS score, rank FROM wide
  WHERE CASE WHEN weak THEN rank <= k + 5 AND score >= greatest(0, least - 0.1::DOUBLE) ELSE rank <= k AND score >= least END),
found AS (SELECT * FROM chosen JOIN incidents ON incident_id = id),
blocks AS ({_HITS.split("blocks AS (", 1)[1].rsplit(")", 1)[0]}),
listed AS (SELECT query_id, string_agg(rank || ':' || incident_id || ':' || printf('%.6f', score::DOUBLE) || ':' || md5(description)
    || ':' || source || ':' || epoch_us(created_at), ',' ORDER BY rank) AS hits FROM found GROUP BY query_id)"""

ASKED_PROMPT = """'T ' || title || ' (' || t.category || ', ' || severity || ')' || chr(10) || description
  || chr(10) || '{past}' || chr(10) || coalesce(similar_incidents, 'No similar incidents found.') || chr(10) || 'end'"""


def asked_turns(turns, vectors):
    """Turns that ask with one of so many ``vectors``."""
    key = F.col("conv_id") * 100 + F.col("turn")
    own = F.col("conv_id") + F.col("turn")
    return turns.select(
        key.alias("query_id"),
        F.concat("role", F.repeat(F.lit("!"), (F.col("turn") % 4).cast("int"))).alias("title"),
        F.col("text").alias("description"),
        (key % vectors).alias("vec_id"),
        (own % 4 + 1).alias("top_k"),
        ((own % 5) / 10.0).alias("similarity_threshold"),
    )


def listed_hits(hits="similar_incidents"):
    return F.when(
        F.size(hits) > 0,
        F.array_join(
            F.transform(
                F.array_sort(hits),
                lambda h: F.concat_ws(
                    ":", h["rank"], h["incident_id"], F.format_string("%.6f", h["similarity_score"]), F.md5(h["description"]),
                    h["source"], F.unix_micros(h["created_at"]),
                ),
            ),
            ",",
        ),
    )


@query(
    "analyze",
    f"""WITH {DOCUMENT_INCIDENTS}, {ASKED},
{rules_sql.keyword_scores('asked', 'query_id', "title || ' ' || description")}, {RELAXED},
judged AS (SELECT *, {rules_sql.severity_case("lower(title || ' ' || description)")} AS severity FROM asked)
SELECT query_id, t.category AS predicted_category, severity AS predicted_severity,
       round(t.confidence, 6) AS category_confidence, {_ANALYZED['root_cause']} AS root_cause_hypothesis,
       {_ANALYZED['citations']} AS citations, {_ANALYZED['attempts']} AS attempts, hits,
       CASE WHEN length(title) % 4 < 2 THEN md5({ASKED_PROMPT}) ELSE 'LLM analysis unavailable' END AS summary
FROM judged JOIN by_text t USING (query_id) LEFT JOIN blocks USING (query_id) LEFT JOIN listed USING (query_id)""",
)
def analyzed(spark, sf_dir):
    """All turns as new incidents, all documents with a vector as past ones."""
    asked = asked_turns(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "embeddings").count())
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    done = analyze(
        asked.join(vectors, "vec_id"), document_incidents(spark, sf_dir), corpus(spark, sf_dir), echo_by_title, template=PROMPT_TEMPLATE
    )
    return done.select(
        "query_id",
        "predicted_category",
        "predicted_severity",
        F.round("category_confidence", 6).alias("category_confidence"),
        "root_cause_hypothesis",
        F.size("citations").alias("citations"),
        "attempts",
        listed_hits().alias("hits"),
        F.col("analysis_summary").alias("summary"),
    )


# --- evaluation ----------------------------------------------------------------

_WORDS = ["the", "LE", "und", "disk", "er", "xyz"]


def _cases_and_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    case_id = F.concat(F.lit("case-"), F.col("doc_id"))
    words = F.array(*[F.lit(w) for w in _WORDS])
    cases = docs.select(
        case_id.alias("case_id"),
        F.col("lang").alias("title"),
        F.col("source").alias("description"),
        choice(KNOWN_CATEGORIES, F.col("doc_id")).alias("expected_category"),
        choice(SEVERITIES, F.col("doc_id")).alias("expected_severity"),
        F.slice(words, F.lit(1), (F.col("doc_id") % 7).cast("int")).alias("expected_keywords"),
        (F.col("doc_id") % 3 != 0).alias("should_cite_similar"),
    )
    hit = F.struct(F.lit("x").alias("incident_id"))
    results = docs.filter("doc_id % 19 <> 5").select(
        case_id.alias("case_id"),
        choice(KNOWN_CATEGORIES, F.col("n_chars")).alias("predicted_category"),
        choice(SEVERITIES, F.col("n_chars")).alias("predicted_severity"),
        F.lit(0.5).alias("category_confidence"),
        F.array_repeat(hit, (F.col("doc_id") % 6).cast("int")).alias("similar_incidents"),
        F.array_repeat(hit, (F.col("doc_id") % 2).cast("int")).alias("citations"),
        F.slice(F.array(F.col("lang"), F.lit("check the disk"), F.col("source")), F.lit(1), (F.col("doc_id") % 4).cast("int")).alias(
            "recommended_actions"
        ),
        F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise("").alias("root_cause_hypothesis"),
        F.when(F.col("doc_id") % 8 != 0, F.col("source")).otherwise("").alias("analysis_summary"),
        (F.col("doc_id") % 23 != 7).alias("success"),
        F.when(F.col("doc_id") % 23 == 7, "model is busy").alias("error"),
        ((F.col("doc_id") % 10) / 4.0).alias("latency_seconds"),
    )
    return results, cases


_KEYWORD_LIST = "[" + ", ".join(sql_str(w.lower()) for w in _WORDS) + "]"

_SCORED = f"""made AS (
  SELECT doc_id, lang, source, n_chars, text,
         {sql_choice(KNOWN_CATEGORIES, 'doc_id')} AS expected_category, {sql_choice(SEVERITIES, 'doc_id')} AS expected_severity,
         {sql_choice(KNOWN_CATEGORIES, 'n_chars')} AS predicted_category, {sql_choice(SEVERITIES, 'n_chars')} AS predicted_severity,
         list_slice({_KEYWORD_LIST}, 1, doc_id % 7) AS words,
         list_slice([lang, 'check the disk', source], 1, doc_id % 4) AS actions,
         CASE WHEN doc_id % 9 <> 0 THEN text ELSE '' END AS cause, CASE WHEN doc_id % 8 <> 0 THEN source ELSE '' END AS summary,
         doc_id % 19 <> 5 AND doc_id % 23 <> 7 AS success FROM documents),
judged AS (
  SELECT *, lower(cause || ' ' || array_to_string(actions, ' ') || ' ' || summary) AS said FROM made),
scored AS (
  SELECT 'case-' || doc_id AS case_id, success,
         CASE WHEN doc_id % 19 = 5 THEN 'no result' WHEN NOT success THEN 'model is busy' END AS error,
         CASE WHEN success THEN (doc_id % 10) / 4.0::DOUBLE END AS latency_seconds,
         CASE WHEN success THEN predicted_category = expected_category END AS category_correct,
         CASE WHEN success THEN predicted_severity = expected_severity END AS severity_correct,
         CASE WHEN success THEN doc_id % 6 END AS retrieved_count,
         CASE WHEN success THEN doc_id % 2 END AS citation_count,
         CASE WHEN success THEN doc_id % 3 = 0 OR doc_id % 2 = 1 END AS has_required_citations,
         CASE WHEN success THEN cause <> '' END AS has_root_cause,
         CASE WHEN success THEN doc_id % 4 END AS action_count,
         CASE WHEN success THEN summary <> '' END AS has_summary,
         CASE WHEN success THEN len(list_filter(words, lambda w: contains(said, w))) END AS keywords_found,
         CASE WHEN success THEN doc_id % 7 END AS keywords_expected,
         CASE WHEN success THEN CASE WHEN doc_id % 7 = 0 THEN 1 ELSE len(list_filter(words, lambda w: contains(said, w))) / (doc_id % 7) END END AS coverage
  FROM judged)"""

_CASE_COLUMNS = [
    "case_id", "success", "error", "latency_seconds", "category_correct", "severity_correct", "has_required_citations",
    "has_root_cause", "has_summary",
]
_CASE_COUNTS = ["retrieved_count", "citation_count", "action_count", "keywords_found", "keywords_expected"]


@query(
    "score_cases",
    f"""WITH {_SCORED} SELECT {', '.join(_CASE_COLUMNS)}, {', '.join(f'{c}::BIGINT AS {c}' for c in _CASE_COUNTS)},
round(coverage, 6) AS keyword_coverage FROM scored""",
)
def score_cases(spark, sf_dir):
    results, cases = _cases_and_results(spark, sf_dir)
    per_case = evaluation.score_cases(results, cases)
    return per_case.select(
        *_CASE_COLUMNS,
        *[F.col(c).cast("bigint").alias(c) for c in _CASE_COUNTS],
        F.round("keyword_coverage", 6).alias("keyword_coverage"),
    )


_RATES = {
    "avg_latency_seconds": "latency_seconds",
    "category_accuracy": "category_correct::INT",
    "severity_accuracy": "severity_correct::INT",
    "avg_retrieved": "retrieved_count",
    "citation_rate": "has_required_citations::INT",
    "root_cause_rate": "has_root_cause::INT",
    "avg_actions": "action_count",
    "avg_keyword_coverage": "coverage",
}


@query(
    "evaluation_summary",
    f"""WITH {_SCORED} SELECT count(*) AS total_cases, count(*) FILTER (success) AS successful_cases,
round(count(*) FILTER (success) / count(*), 6) AS success_rate,
{', '.join(f'round(avg({sql}) FILTER (success), 6) AS {name}' for name, sql in _RATES.items())} FROM scored""",
)
def evaluation_summary(spark, sf_dir):
    results, cases = _cases_and_results(spark, sf_dir)
    _, summary = evaluation.evaluate(results, cases)
    return summary.select(
        "total_cases", "successful_cases", *[F.round(c, 6).alias(c) for c in ["success_rate", *_RATES]]
    )
