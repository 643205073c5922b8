"""Rules, metrics and the learned classifier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from checks import rules_sql
from checks.tables import (
    DOCUMENT_INCIDENTS,
    LABEL_SETS_SQL,
    PHRASES,
    PREDICTIONS,
    choice,
    document_incidents,
    label_sets,
    predictions,
    sql_choice,
    sql_list,
    sql_str,
    table,
)
from triagelake.functions import rules
from triagelake.operators import classifier, metrics, profile, splitting
from triagelake.operators.classify import classify
from triagelake.schema import KNOWN_CATEGORIES
from triagelake.session import scratch_path
from triagelake.sources.models import load_model, save_model

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


_CLASSIFIED = f"""{DOCUMENT_INCIDENTS},
{rules_sql.keyword_scores('incidents', 'id', "title || ' ' || description")},
classified AS (
  SELECT id, t.category AS predicted_category, t.confidence AS category_confidence,
         {rules_sql.severity_case("lower(title || ' ' || description)")} AS predicted_severity
  FROM incidents JOIN by_text t USING (id))"""


@query(
    "rule_profile",
    f"""WITH {_CLASSIFIED}
SELECT predicted_category AS category, predicted_severity AS severity, count(*) AS incidents
FROM classified GROUP BY ALL""",
)
def rule_profile(spark, sf_dir):
    """How many incidents fall to each category and severity by the rules."""
    judged = classify(document_incidents(spark, sf_dir))
    return profile.severity_by_category(
        judged.select(F.col("predicted_category").alias("category"), F.col("predicted_severity").alias("severity"))
    )


@query(
    "classify",
    f"""WITH {_CLASSIFIED}
SELECT id, predicted_category, round(category_confidence, 6) AS confidence, predicted_severity FROM classified""",
)
def classify_documents(spark, sf_dir):
    return classify(document_incidents(spark, sf_dir)).select(
        "id", "predicted_category", F.round("category_confidence", 6).alias("confidence"), "predicted_severity"
    )


@query(
    "category_from_text_expressions",
    f"""WITH {rules_sql.keyword_scores('pages', 'page_id', 'html')}
SELECT page_id, category, round(confidence, 6) AS confidence FROM by_text""",
)
def category_from_text_expressions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    best = rules.category_from_text("html", engine="expr")
    return pages.select("page_id", best.alias("b")).select(
        "page_id", "b.category", F.round("b.confidence", 6).alias("confidence")
    )


@query(
    "category_from_labels",
    f"""WITH labelled AS (SELECT o_orderkey AS id, {LABEL_SETS_SQL} AS labels FROM orders),
{rules_sql.label_category('labelled', 'id')}
SELECT id, category FROM by_label""",
)
def category_from_labels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), rules.category_from_labels(label_sets()).alias("category"))


_SEVERITY_TEXT = f"lower(o_orderpriority || ' ' || {sql_choice(PHRASES, 'o_orderkey')})"
_SEVERITY_LABELS = f"list_transform({LABEL_SETS_SQL}, lambda x: lower(x))"


@query(
    "severity_rules",
    f"""SELECT o_orderkey AS id, {rules_sql.severity_case(_SEVERITY_TEXT)} AS severity,
       {rules_sql.issue_severity_case(_SEVERITY_TEXT, _SEVERITY_LABELS)} AS issue_severity
FROM orders""",
)
def severity_rules(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    phrase = choice(PHRASES, F.col("o_orderkey"))
    return orders.select(
        F.col("o_orderkey").alias("id"),
        rules.estimate_severity("o_orderpriority", phrase).alias("severity"),
        rules.infer_issue_severity("o_orderpriority", phrase, label_sets()).alias("issue_severity"),
    )


# --- metrics -----------------------------------------------------------------------

_CLASSES = ", ".join(f"({sql_str(c)}, {i})" for i, c in enumerate(KNOWN_CATEGORIES))


@query(
    "confusion_matrix",
    f"""WITH {PREDICTIONS}, classes(name, place) AS (VALUES {_CLASSES})
SELECT a.name AS actual, p.name AS predicted, (SELECT count(*) FROM predictions x WHERE x.actual = a.name AND x.predicted = p.name) AS n
FROM classes a CROSS JOIN classes p""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir))


@query(
    "confusion_matrix_wide",
    f"WITH {PREDICTIONS} SELECT actual, "
    + ", ".join(f"count(*) FILTER (predicted = {sql_str(c)}) AS {c}" for c in KNOWN_CATEGORIES)
    + " FROM predictions GROUP BY actual",
)
def confusion_matrix_wide(spark, sf_dir):
    return metrics.confusion_matrix_wide(predictions(spark, sf_dir))


@query(
    "classification_report",
    f"""WITH {PREDICTIONS},
labels AS (SELECT DISTINCT actual AS label FROM predictions UNION SELECT DISTINCT predicted FROM predictions),
per AS (SELECT label, (SELECT count(*) FROM predictions WHERE actual = label) AS support,
               (SELECT count(*) FROM predictions WHERE predicted = label) AS claimed,
               (SELECT count(*) FROM predictions WHERE predicted = label AND actual = label) AS hits FROM labels),
scored AS (SELECT label, coalesce(hits / nullif(claimed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r,
                  coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f, support, hits FROM per)
SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1_score, support::BIGINT AS support FROM scored
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 9), sum(support)::BIGINT FROM scored
UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), sum(support)::BIGINT FROM scored
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9),
                 round(sum(f * support) / sum(support), 9), sum(support)::BIGINT FROM scored""",
)
def classification_report(spark, sf_dir):
    report = metrics.classification_report(predictions(spark, sf_dir))
    return report.select("label", *[F.round(c, 9).alias(c) for c in ["precision", "recall", "f1_score"]], "support")


@query(
    "accuracy",
    f"""WITH {PREDICTIONS}
SELECT count(*) AS labelled, count(*) FILTER (actual = predicted) AS correct,
       count(*) FILTER (actual = predicted) / count(*) AS accuracy FROM predictions""",
)
def accuracy(spark, sf_dir):
    return metrics.accuracy(predictions(spark, sf_dir))


@query(
    "top_confusions",
    f"""WITH {PREDICTIONS}
SELECT actual, predicted, count(*) AS n FROM predictions WHERE actual <> predicted
GROUP BY ALL ORDER BY n DESC, actual, predicted LIMIT 5""",
)
def top_confusions(spark, sf_dir):
    return metrics.top_confusions(predictions(spark, sf_dir), 5)


@query(
    "sample_predictions",
    f"""WITH {PREDICTIONS}
SELECT id, actual, predicted, actual = predicted AS correct FROM predictions
QUALIFY row_number() OVER (PARTITION BY actual = predicted ORDER BY id) <= 5""",
)
def sample_predictions(spark, sf_dir):
    return metrics.sample_predictions(predictions(spark, sf_dir), 10)


# --- the learned classifier ----------------------------------------------------------


@query(
    "stratified_split",
    """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id)
       <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY lang))::BIGINT AS is_test FROM documents""",
)
def stratified_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splitting.stratified_split(docs, 0.2, 42, label="lang", id_col="doc_id")


_STOP_WORDS = ["the", "and", "of", "to", "in", "is", "la", "le", "les", "de", "der", "die", "und", "el", "en"]

_TFIDF = f"""tokens AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({sql_list(_STOP_WORDS)}, w)) AS w
  FROM documents),
terms AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(list_slice(w, 2, len(w)), lambda x, i: w[i] || ' ' || x))) AS term FROM tokens),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS docs FROM documents),
vocabulary AS (
  SELECT term, count(*) AS df, ln((1.0::DOUBLE + max(docs)) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
  FROM counts, n GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * max(docs)
  ORDER BY sum(tf) DESC, term LIMIT 5000),
weighted AS (SELECT doc_id, term, tf, idf, tf * idf AS w FROM counts JOIN vocabulary USING (term)),
normed AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM weighted)"""


@query(
    "tfidf_table",
    f"""WITH {_TFIDF}
SELECT term, count(*) AS documents, sum(tf)::BIGINT AS total, round(any_value(idf), 6) AS idf, round(sum(weight), 4) AS weight
FROM normed GROUP BY term""",
)
def tfidf_table(spark, sf_dir):
    """Weights of all terms of all texts, summed per term."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = classifier.tfidf_table(docs, "text", "doc_id", _STOP_WORDS)
    return weights.groupBy("term").agg(
        F.count("*").alias("documents"),
        F.sum("tf").alias("total"),
        F.round(F.first("idf"), 6).alias("idf"),
        F.round(F.sum("weight"), 4).alias("weight"),
    )


@query(
    "saved_features",
    f"""WITH {_TFIDF.replace("ORDER BY sum(tf) DESC, term LIMIT 5000", "")}
SELECT term, count(*) AS documents, round(sum(weight), 4) AS weight, round(max(weight), 6) AS most FROM normed GROUP BY term""",
)
def saved_features(spark, sf_dir):
    """Feature values of all texts and terms, from fitted stages that were saved and loaded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "features")
    PipelineModel(classifier.tfidf_features(docs, "text", classifier.MOST_FEATURES, _STOP_WORDS)).write().save(path)
    stages = PipelineModel.load(path)
    terms = next(s.vocabulary for s in stages.stages if isinstance(s, CountVectorizerModel))
    names = spark.createDataFrame(pa.table({"place": pa.array(range(len(terms)), pa.int32()), "term": pa.array(terms, pa.string())}))
    vectors = stages.transform(docs).select(F.unwrap_udt("features").alias("v"))
    values = vectors.select(F.explode(F.arrays_zip(F.col("v.indices").alias("place"), F.col("v.values").alias("weight"))).alias("e")).select("e.*")
    sums = values.groupBy("place").agg(F.count("*").alias("documents"), F.sum("weight").alias("weight"), F.max("weight").alias("most"))
    return sums.join(names, "place").select("term", "documents", F.round("weight", 4).alias("weight"), F.round("most", 6).alias("most"))


@query(
    "class_weights",
    """SELECT source, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""",
)
def class_weights(spark, sf_dir):
    weights = classifier.class_weights(table(spark, sf_dir, "documents"), "source")
    return weights.select("source", "n", F.round("weight", 9).alias("weight"))


_CLASS_WORDS = {c: f"{c}one {c}two {c}three" for c in KNOWN_CATEGORIES}


@query(
    "train_on_disjoint_words",
    f"SELECT 'doc-' || doc_id AS id, {sql_choice(KNOWN_CATEGORIES, 'doc_id')} AS predicted, true AS sure FROM documents",
)
def train_on_disjoint_words(spark, sf_dir):
    """Where the words of classes have nothing in common, every prediction must be the class itself; by the model as saved and loaded."""
    docs = table(spark, sf_dir, "documents")
    own = choice(KNOWN_CATEGORIES, F.col("doc_id"))
    words = choice(list(_CLASS_WORDS.values()), F.col("doc_id"))
    rows = docs.select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.lit("same title").alias("title"), words.alias("description"), own.alias("category")
    )
    model, numbers = classifier.train_classifier(rows)
    if numbers["accuracy"] != 1.0:
        raise ValueError(f"accuracy {numbers['accuracy']} where classes are apart")
    path = scratch_path(spark, "classifier")
    save_model(model, path)
    judged = classifier.predict(load_model(path), rows.drop("category"))
    return judged.select("id", "predicted", (F.col("confidence") > 1 / len(KNOWN_CATEGORIES)).alias("sure"))


@query("train_and_predict", None)
def train_and_predict(spark, sf_dir):
    """Learn the keyword rule from the labelled documents, then judge all documents."""
    documents = document_incidents(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"))
    # Spark does not move a join below a Python function: only labelled documents are to be judged.
    judged = classify(documents.join(ids, "id", "left_semi")).withColumn("category", F.col("predicted_category"))
    labelled = judged.select("id", "title", "description", "category")
    model, _ = classifier.train_classifier(labelled)
    return (
        classifier.predict(model, documents.select("id", "title", "description"))
        .groupBy(F.col("predicted").alias("category"))
        .agg(F.count("*").alias("incidents"), F.round(F.avg("confidence"), 2).alias("confidence"))
    )
