"""Prompts of a stream that are asked again in later batches instead of at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from triagelake.operators.generation import BATCH_SIZE, MAX_ROUNDS, Responder, ask_round, to_ask_again
from triagelake.session import delete

WAITING = "query_id {id}, prompt string, generation_error string, _alone boolean, attempts int"
ANSWER = ("query_id", "response", "response_error", "attempts", "passed", "generation_error")


def generate_stream(
    stream: DataFrame,
    fn: Responder,
    out: str,
    checkpoint: str,
    max_rounds: int = MAX_ROUNDS,
    batch_size: int = BATCH_SIZE,
    ticks: bool = False,
) -> DataStreamWriter:
    """Answers to arriving ``(query_id, prompt)`` rows below ``out``, one round of the model per micro-batch.

    A prompt that fails waits for the next micro-batch, so a model that is down for less than ``max_rounds``
    of them costs no answer. It comes out when it has passed or has been sent ``max_rounds`` times.
    ``out`` belongs to ``checkpoint``. It holds, per micro-batch, what was answered for good and what waits; the
    waiting rows are the state, a table like any other, so neither a task nor the driver holds them.
    A micro-batch that runs again takes the answers that it has written, if the model had been asked
    by then. With ``ticks``, micro-batches go on when nothing arrives; use a trigger with the interval at
    which to ask again. Rows with a null id or prompt are left out.
    """
    rows = stream.select("query_id", "prompt")
    if ticks:
        beats = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", "1").load()
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        rows = rows.unionByName(beats.select(*nothing))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked_path = f"{out}/asked/batch_id={batch_id}"
        if not exists(spark, f"{asked_path}/_SUCCESS"):
            new = batch.where("query_id is not null and prompt is not null").select(
                "query_id", "prompt", F.lit(None).cast("string").alias("generation_error"),
                F.lit(False).alias("_alone"), F.lit(0).alias("attempts"),
            )
            pending = new.unionByName(waiting_after(spark, out, batch_id - 1, batch.schema))
            answered = ask_round(pending, fn, batch_size).withColumn("attempts", F.col("attempts") + 1)
            answered.write.mode("overwrite").parquet(asked_path)
        answered = spark.read.parquet(asked_path)
        done = F.col("passed") | (F.col("attempts") >= max_rounds)
        answered.where(done).select(*ANSWER).write.mode("overwrite").parquet(f"{out}/answers/batch_id={batch_id}")
        to_ask_again(answered.where(~done), "attempts").write.mode("overwrite").parquet(waiting_path(out, batch_id))
        # The batch before may still be asked for, if this one runs again; the one before that may not.
        for old in (f"{out}/asked/batch_id={batch_id - 2}", waiting_path(out, batch_id - 2)):
            delete(spark, old)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def waiting_path(out: str, batch_id: int) -> str:
    return f"{out}/waiting/batch_id={batch_id}"


def waiting_after(spark: SparkSession, out: str, batch_id: int, schema) -> DataFrame:
    """Prompts that wait after a micro-batch; none before the first."""
    names = WAITING.format(id=schema["query_id"].dataType.simpleString())
    if batch_id < 0:
        return spark.createDataFrame([], names)
    return spark.read.schema(names).parquet(waiting_path(out, batch_id))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
