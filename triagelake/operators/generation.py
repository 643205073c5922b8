"""Asking the caller's model, with checked answers and a bounded number of retries."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.responses import (
    extract_json,
    json_text,
    parse_actions,
    parse_citations,
    text_field,
    validate_response,
)
from triagelake.operators.prompts import with_feedback
from triagelake.schema import CITATION_TYPE
from triagelake.session import cut

# --- fixed values -----------------------------------------------------------
MAX_ROUNDS = 3
FALLBACK_CAUSE = "Unable to generate analysis: "
FALLBACK_ACTIONS = ["Investigate manually", "Check logs", "Review recent changes"]
FALLBACK_IMPACT = "Unknown - requires manual assessment"
FALLBACK_SUMMARY = "LLM analysis unavailable"
# ----------------------------------------------------------------------------

BATCH_SIZE = 32

# Handed to models that take a part of the prompt in the system's name.
SYSTEM_PROMPT = "You help engineers on call to understand an incident. Your whole answer is one JSON object and nothing else."

# ``fn(prompts)``, or ``fn(prompts, system=...)`` where it has that parameter. For a prompt it
# cannot answer it may return an exception instead of a text.
Responder = Callable[..., Sequence[str | Exception | None]]


def takes_system(fn: Responder) -> bool:
    try:
        return "system" in inspect.signature(fn).parameters
    except (TypeError, ValueError):
        return False


def respond(
    prompts: DataFrame, fn: Responder, batch_size: int = BATCH_SIZE, system: str = SYSTEM_PROMPT
) -> DataFrame:
    """Add ``response`` and ``response_error`` by calling ``fn`` on lists of prompts.

    Every prompt is sent once. If a call fails as a whole, all its prompts carry the error.
    Rows with a true ``_alone`` are sent by themselves.
    """
    more = {"system": system} if takes_system(fn) else {}
    added = [T.StructField("response", T.StringType()), T.StructField("response_error", T.StringType())]
    schema = T.StructType([*prompts.schema.fields, *added])

    def ask(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(fn(texts, **more))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers for {len(texts)} prompts")
            return [(None, str(a)) if isinstance(a, Exception) else (a, None) for a in answers]
        except Exception as problem:  # whatever the caller's model throws
            return [(None, str(problem))] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alone = batch["_alone"].tolist() if "_alone" in batch else [False] * len(batch)
            together = [i for i, a in enumerate(alone) if not a]
            calls = [together[i : i + batch_size] for i in range(0, len(together), batch_size)]
            calls += [[i] for i, a in enumerate(alone) if a]
            texts, pairs = batch["prompt"].tolist(), [(None, None)] * len(batch)
            for call in calls:
                for i, pair in zip(call, ask([texts[i] for i in call]), strict=True):
                    pairs[i] = pair
            yield batch.assign(
                response=pd.Series([p[0] for p in pairs], index=batch.index, dtype=object),
                response_error=pd.Series([p[1] for p in pairs], index=batch.index, dtype=object),
            )

    return prompts.mapInPandas(run, schema)


def check_answers(answered: DataFrame) -> DataFrame:
    """Add ``passed`` and ``generation_error`` to rows with a ``response``."""
    return (
        answered.withColumn("_answer", extract_json("response"))  # parsed once, used many times
        .withColumn("_verdict", validate_response("_answer"))
        .withColumn("passed", F.col("_verdict.passed"))
        .withColumn("generation_error", F.col("_verdict.error"))
        .drop("_verdict", "_answer")
    )


def ask_round(pending: DataFrame, fn: Responder, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Send each pending prompt once, with what was wrong with the answer before, and check the answers.

    ``pending`` has query_id, prompt, generation_error, ``_alone`` and what else the caller carries.
    """
    others = [c for c in pending.columns if c not in ("prompt", "generation_error")]
    asked = pending.select(
        *others, F.col("prompt").alias("_first"), with_feedback(F.col("prompt"), F.col("generation_error")).alias("prompt")
    )
    return check_answers(respond(asked, fn, batch_size))


def to_ask_again(failed: DataFrame, *carried: str) -> DataFrame:
    """Pending prompts of the next round. Those whose call failed are sent alone from then on."""
    alone = F.col("_alone") | F.col("response_error").isNotNull()
    return failed.select("query_id", F.col("_first").alias("prompt"), "generation_error", alone.alias("_alone"), *carried)


def generation_rounds(
    prompts: DataFrame, fn: Responder, max_rounds: int = MAX_ROUNDS, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Last answer per query: ``(query_id, response, response_error, attempts,
    passed, generation_error)``.

    Each round asks only for the rows that still fail and is written to the
    shared folder before it is looked at, so no prompt is sent twice by a plan
    that runs again. Prompts whose call failed are sent alone from then on, so a prompt
    that spoils a list costs the others one round. No prompt is sent more than
    ``max_rounds`` times.
    """
    pending = prompts.select(
        "query_id", "prompt", F.lit(None).cast("string").alias("generation_error"), F.lit(False).alias("_alone")
    )
    finished = []
    for attempt in range(1, max_rounds + 1):
        answered = ask_round(pending, fn, batch_size).withColumn("attempts", F.lit(attempt))
        answered = cut(answered, f"answers-{attempt}")
        failed = answered.filter(~F.col("passed"))
        last = attempt == max_rounds or failed.isEmpty()
        finished.append(answered if last else answered.filter("passed"))
        if last:
            break
        pending = to_ask_again(failed)
    return reduce(DataFrame.unionByName, finished).select(
        "query_id", "response", "response_error", "attempts", "passed", "generation_error"
    )


def results(answers: DataFrame) -> DataFrame:
    """Answer fields of rows that passed, the fixed answer for those that never did."""
    passed = F.col("passed")
    no_citations = F.array().cast(f"array<{CITATION_TYPE.simpleString()}>")
    cause = F.concat(F.lit(FALLBACK_CAUSE), F.coalesce("generation_error", F.lit("None")))
    fallback_actions = F.array(*[F.lit(a) for a in FALLBACK_ACTIONS])
    fields = {
        "root_cause_hypothesis": (text_field("_answer", "root_cause_hypothesis"), cause),
        "recommended_actions": (parse_actions("_answer"), fallback_actions),
        "estimated_impact": (text_field("_answer", "estimated_impact"), F.lit(FALLBACK_IMPACT)),
        "citations": (parse_citations("_answer"), no_citations),
        "analysis_summary": (text_field("_answer", "analysis_summary"), F.lit(FALLBACK_SUMMARY)),
        "raw_llm_response": (json_text("response"), F.lit(None).cast("string")),
    }
    return answers.withColumn("_answer", F.when(passed, extract_json("response"))).select(
        *answers.columns,
        *[F.when(passed, good).otherwise(bad).alias(name) for name, (good, bad) in fields.items()],
    )


def build_results(answers: DataFrame) -> DataFrame:
    return results(answers.filter("passed"))


def fallback_results(answers: DataFrame) -> DataFrame:
    return results(answers.filter(~F.col("passed")))
