"""Streaming queries, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import rules_sql
from checks.answers import (
    ASKED,
    ASKED_PROMPT,
    PROMPT_TEMPLATE,
    RELAXED,
    ROUNDS_SQL,
    asked_turns,
    echo_by_title,
    listed_hits,
    outcome_sql,
    stand_in,
)
from checks.tables import (
    DOCUMENT_INCIDENTS,
    SCORES,
    SHOWN,
    corpus,
    document_incidents,
    table,
)
from triagelake.session import cut, scratch_path
from triagelake.sources.incidents import write_incidents
from triagelake.streaming import streams
from triagelake.streaming.retries import generate_stream

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; it may be one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    # A pattern with one match: a stream takes a plain path for a folder, whose files only it would list.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def finish(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()


@query(
    "classify_stream",
    f"""WITH arriving AS (SELECT conv_id * 100 + turn AS id, role || ' ' || text AS t FROM conversations),
{rules_sql.keyword_scores('arriving', 'id', 't')}
SELECT id, category, round(confidence, 6) AS confidence, {rules_sql.severity_case("lower(t)")} AS severity
FROM by_text JOIN arriving USING (id)""",
)
def classify_stream(spark, sf_dir):
    arriving = table_stream(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("title"), F.col("text").alias("description")
    )
    judged = streams.classify_stream(arriving).select(
        "id",
        F.col("predicted_category").alias("category"),
        F.round("category_confidence", 6).alias("confidence"),
        F.col("predicted_severity").alias("severity"),
    )
    out, checkpoint = scratch_path(spark, "classified"), scratch_path(spark, "classified-checkpoint")
    finish(judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint))
    return spark.read.schema(judged.schema).parquet(out)


def sized_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents joined by id with the lengths of documents.

    An id that stands once brings its own length, so only ids that repeat are joined, and texts move
    only if these are many.
    """
    own = document_incidents(spark, sf_dir, "n_chars").where("id IS NOT NULL")
    sizes = own.select("id", "n_chars")
    repeated = sizes.groupBy("id").count().where("count > 1")
    others = cut(sizes.join(repeated, "id", "left_semi").select("id", F.col("n_chars").alias("_other"), F.lit(True).alias("_repeated")), "repeated")
    size = F.when(F.col("_repeated"), F.col("_other")).otherwise(F.col("n_chars"))
    return own.join(others, "id", "left").withColumn("n_chars", size).drop("_other", "_repeated")


_REVISED = "n_chars % 4 = 0"
_REPEATED = "n_chars % 4 = 1"
_RESTORED = "n_chars % 8 = 0"
_UNSEEN = "n_chars % 5 = 0"


@query(
    "ingest_stream",
    f"""WITH {DOCUMENT_INCIDENTS}, sized AS (SELECT i.*, d.n_chars FROM incidents i JOIN documents d ON i.id = 'doc-' || d.doc_id),
revised AS (SELECT * REPLACE (description || ' (revised)' AS description, created_at - INTERVAL 300 DAY AS created_at) FROM sized WHERE {_REVISED}),
unseen AS (SELECT * REPLACE ('late-' || id AS id, created_at - INTERVAL 700 DAY AS created_at) FROM sized WHERE {_UNSEEN}),
arrived AS (
  SELECT *, 'new' AS change, 1 AS version FROM sized UNION ALL SELECT *, 'overtaken', NULL FROM sized
  UNION ALL SELECT *, 'changed', 2 FROM revised UNION ALL SELECT *, 'unchanged', 1 FROM sized WHERE {_REPEATED}
  UNION ALL SELECT *, 'changed', 3 FROM sized WHERE {_RESTORED} UNION ALL SELECT *, 'new', 1 FROM unseen),
now AS (SELECT * FROM arrived WHERE change IN ('new', 'changed') QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)
SELECT 'arrival' AS part, id, category, md5(description) AS digest, epoch_us(created_at) AS created_us, change, version::BIGINT AS version, NULL::VARCHAR AS error FROM arrived
UNION ALL SELECT 'current', id, category, md5(description), epoch_us(created_at), NULL, NULL, NULL FROM now
UNION ALL SELECT 'rejected', 'bad-' || id, NULL, md5(description), NULL, NULL, NULL, 'invalid source: fax' FROM sized WHERE source = 'manual'""",
)
def ingest_stream(spark, sf_dir):
    """Three runs over one folder: every incident twice, then corrections dated back and repeats, then old versions
    again and unseen incidents older than all before."""
    sized = sized_incidents(spark, sf_dir)
    bad = sized.where("source = 'manual'").withColumns({"id": F.concat(F.lit("bad-"), "id"), "source": F.lit("fax")})
    revised = sized.where(_REVISED).withColumns(
        {"description": F.concat("description", F.lit(" (revised)")), "created_at": F.col("created_at") - F.make_dt_interval(days=F.lit(300))}
    )
    unseen = sized.where(_UNSEEN).withColumns(
        {"id": F.concat(F.lit("late-"), "id"), "created_at": F.col("created_at") - F.make_dt_interval(days=F.lit(700))}
    )
    source = scratch_path(spark, "arriving")
    parts = {name: (scratch_path(spark, f"{name}s"), scratch_path(spark, f"{name}s-checkpoint")) for name in ("arrival", "rejected")}
    for run, rows in enumerate(
        (sized.unionByName(sized).unionByName(bad), revised.unionByName(sized.where(_REPEATED)), sized.where(_RESTORED).unionByName(unseen))
    ):
        write_incidents(rows.drop("n_chars"), f"{source}/run={run}", "json", "gzip")
        streamed = streams.ingest_stream(spark, f"{source}/*", pattern="*.json.gz")
        for (out, checkpoint), stream in zip(parts.values(), streamed, strict=True):
            finish(stream.writeStream.format("parquet").option("compression", "zstd").option("path", out).option("checkpointLocation", checkpoint))
    arrived, rejected = (spark.read.parquet(out) for out, _ in parts.values())
    digest = F.md5("description").alias("digest")
    # Versions are told apart without their texts.
    narrow = arrived.select("id", "category", digest, F.unix_micros("created_at").alias("created_us"), "change", "version", "arrived_at")
    return (
        narrow.drop("arrived_at").withColumn("part", F.lit("arrival"))
        .unionByName(streams.current_versions(narrow).withColumn("part", F.lit("current")), allowMissingColumns=True)
        .withColumn("error", F.lit(None).cast("string"))
        .unionByName(
            rejected.select(F.lit("rejected").alias("part"), "id", digest, F.array_join("errors", "; ").alias("error")),
            allowMissingColumns=True,
        )
        .select("part", "id", "category", "digest", "created_us", "change", "version", "error")
    )


@query(
    "search_stream",
    f"""WITH {SCORES}, {DOCUMENT_INCIDENTS}
SELECT query_id, rank, incident_id, title, category, severity, least(greatest({SHOWN}, 0), 1) AS similarity_score, NULL::VARCHAR AS error FROM (
  SELECT query_id, incident_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, incident_id))::INT AS rank FROM scores)
JOIN incidents ON incident_id = id WHERE rank <= 10 AND score >= 0""",
)
def search_stream(spark, sf_dir):
    arriving = table_stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    out, checkpoint = scratch_path(spark, "searched"), scratch_path(spark, "searched-checkpoint")
    finish(streams.search_stream(arriving, document_incidents(spark, sf_dir), corpus(spark, sf_dir), out, checkpoint))
    return spark.read.parquet(out).drop("batch_id")


_OUTCOME = outcome_sql("title")
_PROBLEMS = """concat_ws('; ', CASE WHEN conv_id % 9 = 0 THEN 'title must be 1 to 500 characters' END,
  CASE WHEN length(description) NOT BETWEEN 1 AND 10000 THEN 'description must be 1 to 10000 characters' END)"""


@query(
    "analyze_stream",
    f"""WITH {DOCUMENT_INCIDENTS}, {ASKED},
{rules_sql.keyword_scores('asked', 'query_id', "title || ' ' || description")}, {RELAXED},
judged AS (SELECT *, {rules_sql.severity_case("lower(title || ' ' || description)")} AS severity, nullif({_PROBLEMS}, '') AS problem FROM asked)
SELECT query_id, problem IS NULL AS success, problem AS error,
       CASE WHEN problem IS NULL THEN t.category END AS predicted_category,
       CASE WHEN problem IS NULL THEN severity END AS predicted_severity,
       CASE WHEN problem IS NULL THEN {_OUTCOME['attempts']} END AS attempts,
       CASE WHEN problem IS NULL THEN {_OUTCOME['root_cause']} END AS root_cause_hypothesis,
       CASE WHEN problem IS NULL THEN hits END AS hits,
       CASE WHEN problem IS NULL THEN CASE WHEN length(title) % 4 < 2 THEN md5({ASKED_PROMPT}) ELSE 'LLM analysis unavailable' END END AS summary
FROM judged JOIN by_text t USING (query_id) LEFT JOIN blocks USING (query_id) LEFT JOIN listed USING (query_id)""",
)
def analyze_stream(spark, sf_dir):
    """All turns as they arrive, each on its own terms; some are out of bounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    turns = table_stream(spark, sf_dir, "conversations")
    asked = asked_turns(turns, vectors.count())
    bad = F.floor(F.col("query_id") / 100) % 9 == 0
    arriving = asked.withColumn("title", F.when(bad, "").otherwise(F.col("title"))).join(vectors, "vec_id").drop("vec_id")
    out, checkpoint = scratch_path(spark, "analyzed"), scratch_path(spark, "analyzed-checkpoint")
    finish(
        streams.analyze_stream(
            arriving, document_incidents(spark, sf_dir), corpus(spark, sf_dir), echo_by_title, out, checkpoint, template=PROMPT_TEMPLATE
        )
    )
    done = spark.read.parquet(out)
    return done.select(
        "query_id", "success", "error", "predicted_category", "predicted_severity", "attempts", "root_cause_hypothesis",
        listed_hits().alias("hits"), F.col("analysis_summary").alias("summary"),
    )


@query("generate_stream", ROUNDS_SQL)
def generate_over_batches(spark, sf_dir):
    """All turns in three micro-batches and two more with nothing in them, one round of the model in each."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"))
    arriving, out = scratch_path(spark, "prompts"), scratch_path(spark, "generated")
    checkpoint = scratch_path(spark, "generated-checkpoint")
    for n in range(5):
        part = asked.where(F.col("query_id") % 3 == n) if n < 3 else asked.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in asked.dtypes])
        part.coalesce(1).write.mode("append").parquet(arriving)
        finish(generate_stream(spark.readStream.schema(asked.schema).parquet(arriving), stand_in, out, checkpoint))
    return spark.read.parquet(f"{out}/answers").select("query_id", "attempts", "passed", "generation_error", "response_error")
