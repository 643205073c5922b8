import json
import time

import pytest

from triagelake.streaming.retries import generate_stream

GOOD = json.dumps({
    "root_cause_hypothesis": "h", "recommended_actions": ["a"], "estimated_impact": "i", "citations": [], "analysis_summary": "s",
})
SCHEMA = "query_id string, prompt string"


def model(log, down):
    """Down for the first calls; never answers ``never``. Writes down what it is sent."""

    def fn(prompts):
        with open(log, "a") as seen:
            calls = [p.split("\n")[0] for p in prompts]
            seen.write("".join(f"{c}\n" for c in calls))
        known = open(log).read().split("\n")
        if any(known.count(c) <= down for c in calls if c != "never"):
            raise ConnectionError("down")
        return [None if c == "never" else GOOD for c in calls]

    return fn


@pytest.fixture
def folders(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()

    def put(name, rows):
        lines = "".join(json.dumps({"query_id": q, "prompt": p}) + "\n" for q, p in rows)
        (tmp_path / name).write_text(lines)
        (tmp_path / name).rename(arriving / name)

    return put, str(arriving), str(tmp_path / "out"), str(tmp_path / "checkpoint"), str(tmp_path / "log")


def answers(spark, out):
    return {r["query_id"]: (r["attempts"], r["passed"], r["response_error"]) for r in spark.read.parquet(f"{out}/answers").collect()}


def test_a_model_that_is_down_for_two_batches(spark, folders):
    put, arriving, out, checkpoint, log = folders
    stream = spark.readStream.schema(SCHEMA).json(arriving)
    arrivals = [[("1", "one"), ("2", "never"), (None, "x"), ("3", None)], [("4", "four")], [], [("5", "five")], [], []]
    for i, rows in enumerate(arrivals):
        put(f"{i}.json", rows or [(None, None)])
        # The query is stopped and started again every time: what waits is in the folder.
        generate_stream(stream, model(log, 2), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = answers(spark, out)
    assert found == {"1": (3, True, None), "2": (3, False, None), "4": (3, True, None), "5": (3, True, None)}
    sent = open(log).read().split()
    assert {c: sent.count(c) for c in sent} == {"one": 3, "never": 3, "four": 3, "five": 3}


def test_a_batch_that_runs_again_asks_nobody_twice(spark, folders):
    put, arriving, out, checkpoint, log = folders
    stream = spark.readStream.schema(SCHEMA).json(arriving)
    put("0.json", [("1", "one"), ("2", "two")])
    generate_stream(stream, model(log, 0), out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    before = answers(spark, out)
    # The same batch 0 for a checkpoint that knows of no batch.
    generate_stream(stream, model(log, 0), out, checkpoint + "-new").trigger(availableNow=True).start().awaitTermination()
    assert answers(spark, out) == before and len(before) == 2
    assert sorted(open(log).read().split()) == ["one", "two"]


def test_ticks_ask_again_when_nothing_arrives(spark, folders):
    put, arriving, out, checkpoint, log = folders
    stream = spark.readStream.schema(SCHEMA).json(arriving)
    put("0.json", [("1", "one")])
    running = generate_stream(stream, model(log, 2), out, checkpoint, ticks=True).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and open(log, "a+").tell() < len("one\n") * 3:
            time.sleep(1)
        time.sleep(5)  # the batch of the last call is written
    finally:
        running.stop()
    assert answers(spark, out) == {"1": (3, True, None)}
