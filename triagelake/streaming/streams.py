"""Streams of incidents, searches and analyses.

Stateless steps are plain transformations. Steps that rank rows run per
micro-batch; each batch replaces its own folder of the output, so a batch that
is run again after a failure leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from triagelake.operators.classify import classify
from triagelake.operators.dedupe import latest_by_id
from triagelake.operators.conform import ERRORS, conform_incidents, require_valid, split_valid, validate_inputs
from triagelake.operators.generation import Responder
from triagelake.operators.similarity import attach_incidents, search, topk_similar
from triagelake.plans.analyze import analyze
from triagelake.plans.search import search_texts
from triagelake.schema import CORRUPT, INCIDENT_FILE_SCHEMA
from triagelake.session import temporary
from triagelake.streaming.versions import REMEMBER, TOLD, arrivals

KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def ingest_stream(
    spark: SparkSession,
    path: str,
    remember: str = REMEMBER,
    pattern: str = "*.jsonl",
    max_files: int | None = None,
    mode: str = "quarantine",
) -> tuple[DataFrame, DataFrame]:
    """``(arrivals, rejected)`` incidents from files that arrive in a folder.

    Every valid row comes out once, with ``change``: new, changed or unchanged for the last version of its id in
    a micro-batch, against the version that came last before; overtaken for a version that
    was followed by another in the same batch. The last to arrive wins, whatever its
    ``created_at``: back-dated and corrected incidents are as good as others. ``version`` counts
    an id's changes; `current_versions` makes the table as it stands.

    State holds a digest and a number per id, and forgets an id that has not changed for
    ``remember``: should it come again, it is new. Order of arrival is that of batches, then
    of files by modification time and name, then of lines. Rejected rows carry their
    ``errors``; they are a stream of their own. mode="failfast" stops at the first bad record instead.

    Both streams belong to a session of their own with the settings of ``spark``, but for two:
    state of this kind lives in RocksDB, and a batch runs only when there are files (as
    ids are forgotten by the clock, batches without any would never end).
    """
    if mode not in ("quarantine", "failfast"):
        raise ValueError(f"unknown mode: {mode}")
    reader = (
        _with_settings(spark, KEYED_STATE).readStream.schema(INCIDENT_FILE_SCHEMA)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", pattern)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    given = [c for c in INCIDENT_FILE_SCHEMA.fieldNames() if c != CORRUPT]
    raw = reader.json(path).select(
        "*",
        # What the record says, before defaults are filled in: a default may be the present time.
        F.sha2(F.to_json(F.struct(*given)), 256).alias("_digest"),
        F.struct(F.unix_micros("_metadata.file_modification_time").alias("at"), "_metadata.file_path", "_metadata.file_block_start").alias("_place"),
    )
    checked = conform_incidents(raw)
    valid, rejected = split_valid(require_valid(checked) if mode == "failfast" else checked)
    return arrivals(valid, remember), rejected.drop("_digest", "_place")


def _with_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session beside ``spark`` with its settings and some of its own."""
    session = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def current_versions(arrived: DataFrame) -> DataFrame:
    """The incidents as they stand, from all arrivals that were written."""
    told = arrived.where(F.col("change").isin(*TOLD))
    return latest_by_id(told, [F.col("arrived_at"), F.col("version")]).drop("change", "version", "arrived_at")


def classify_stream(
    stream: DataFrame, model: PipelineModel | None = None, engine: str = "scan"
) -> DataFrame:
    """Category and severity of arriving incidents."""
    return classify(stream, model, engine)


def search_stream(
    stream: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    out: str,
    checkpoint: str,
    embedder: PipelineModel | None = None,
    embed_fn: Callable | None = None,
    **filters,
) -> DataStreamWriter:
    """Answer arriving searches; start it with ``.start()``.

    Requests are ``(query_id, vec)`` or, with an embedder, ``(query_id, query)``,
    each with the terms that `search` knows. Requests outside the bounds come out with an error.
    """

    def work(batch: DataFrame) -> DataFrame:
        if "vec" in batch.columns:
            found, refused = search(batch, incidents, vectors, **filters)
        else:
            found, refused = search_texts(batch, incidents, vectors, embedder, embed_fn, **filters)
        return found.withColumn("error", F.lit(None).cast("string")).unionByName(
            refused.select("query_id", F.array_join(ERRORS, "; ").alias("error")), allowMissingColumns=True
        )

    return per_batch(stream, work, out, checkpoint)


def similar_stream(
    stream: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    out: str,
    checkpoint: str,
    k: int = 5,
    threshold: float = 0.3,
) -> DataStreamWriter:
    """Similar incidents of arriving ``(query_id, vec)`` rows on common terms."""
    return per_batch(
        stream,
        lambda batch: attach_incidents(topk_similar(batch, vectors, k, threshold), incidents),
        out,
        checkpoint,
    )


def analyze_stream(
    stream: DataFrame,
    incidents: DataFrame,
    vectors: DataFrame,
    fn: Responder,
    out: str,
    checkpoint: str,
    **options,
) -> DataStreamWriter:
    """Analyse arriving ``(query_id, title, description)`` rows.

    Rows that break the input bounds come out with ``success`` false and the reason.
    """

    def work(batch: DataFrame) -> DataFrame:
        valid, rejected = validate_inputs(batch, "analyze")
        done = analyze(valid, incidents, vectors, fn, **options)
        refused = rejected.select("query_id", F.lit(False).alias("success"), F.array_join(ERRORS, "; ").alias("error"))
        return done.withColumns(
            {"success": F.lit(True), "error": F.lit(None).cast("string")}
        ).unionByName(refused, allowMissingColumns=True)

    return per_batch(stream, work, out, checkpoint)


def per_batch(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            with temporary(batch.sparkSession):
                work(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
