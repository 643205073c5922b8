import json

import pytest
from pyspark.sql import functions as F

from triagelake.functions import responses
from triagelake.operators import evaluation, generation, prompts
from triagelake.plans.analyze import analyze
from triagelake.sources.cases import read_golden_cases, write_metrics

GOOD = {"root_cause_hypothesis": "h", "recommended_actions": ["a"], "estimated_impact": "i", "analysis_summary": "s"}


def without(**changes):
    merged = {**GOOD, **changes}
    return json.dumps({k: v for k, v in merged.items() if v is not ...})


CASES = [
    (json.dumps(GOOD), None),
    (None, "LLM response is None"),
    ("not json", "LLM response is None"),
    ("[1, 2]", "LLM response is None"),
    (without(root_cause_hypothesis=...), "Missing required field: root_cause_hypothesis"),
    (without(recommended_actions="not a list"), "Field 'recommended_actions' expected list, got str"),
    (without(recommended_actions=["valid", 123]), "All items in 'recommended_actions' must be strings"),
    (without(recommended_actions=[]), None),
    (without(recommended_actions=[None]), "All items in 'recommended_actions' must be strings"),
    (without(estimated_impact=None), "Field 'estimated_impact' expected str, got NoneType"),
    (without(estimated_impact=1, analysis_summary=...), "Field 'estimated_impact' expected str, got int; Missing required field: analysis_summary"),
    (without(estimated_impact=1.0, analysis_summary=True), "Field 'estimated_impact' expected str, got float; Field 'analysis_summary' expected str, got bool"),
    (without(recommended_actions={"a": 1}), "Field 'recommended_actions' expected list, got dict"),
    (without(recommended_actions=5), "Field 'recommended_actions' expected list, got int"),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, response string")
    got = generation.check_answers(df).orderBy("i").collect()
    assert [r["generation_error"] for r in got] == [e for _, e in CASES]
    assert [r["passed"] for r in got] == [e is None for _, e in CASES]


@pytest.mark.parametrize(
    "text",
    [
        '{"a": 1}', 'before {"a": 1} after', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n``` {"b": 2}', '```json\n{"a": 1}',
        'x ```{"b": 0}``` ```json {"a": 1}```',
    ],
)
def test_extraction(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(responses.extract_json("t").cast("string").alias("j")).first()["j"] == '{"a":1}'


def test_citations(spark):
    answer = json.dumps({"citations": [1, "x", {"incident_id": "i", "text": "t", "relevance": "r"}, {}, {"text": "only"}]})
    df = spark.createDataFrame([(answer,), ("{}",), ('{"citations": 5}',)], "t string")
    got = [[tuple(c) for c in r["c"]] for r in df.select(responses.parse_citations(responses.extract_json("t")).alias("c")).collect()]
    assert got == [[("i", "t", "r"), ("unknown", "", ""), ("unknown", "only", "")], [], []]


FOUND = "query_id string, rank int, score double, incident_id string, title string, category string, severity string, description string, resolution string"


def test_similar_block(spark):
    df = spark.createDataFrame(
        [("q", 2, 0.5, "b", "B", "data", "low", "x" * 600, ""), ("q", 1, 0.875, "a", "A", "outage", "high", "d", "fixed")], FOUND
    )
    text = prompts.format_similar(df).first()["similar_incidents"]
    assert text == (
        "\n### Similar Incident 1 (Similarity: 0.88)\n- ID: a\n- Title: A\n- Category: outage\n- Severity: high\n"
        "- Description: d...\n- Resolution: fixed\n\n\n### Similar Incident 2 (Similarity: 0.50)\n- ID: b\n- Title: B\n"
        "- Category: data\n- Severity: low\n- Description: " + "x" * 500 + "...\n- Resolution: Not resolved yet\n"
    )


def test_prompt_without_hits_and_feedback(spark):
    q = spark.createDataFrame([("q", "T", "D", "data", "low")], "query_id string, title string, description string, predicted_category string, predicted_severity string")
    none = spark.createDataFrame([], FOUND)
    built = prompts.build_prompts(q, none, "{title}|{description}|{category}|{severity}|{similar_incidents}|{{x}}")
    assert built.first()["prompt"] == "T|D|data|low|No similar incidents found.|{x}"
    assert "No similar incidents found." in prompts.build_prompts(q, none).first()["prompt"]
    asked = built.select(prompts.with_feedback(F.col("prompt"), F.lit("bad")).alias("p")).first()["p"]
    assert asked.endswith("\n\nPrevious attempt failed validation: bad\nPlease fix the issue and provide a valid JSON response.")


def test_rounds_and_number_of_calls(spark, tmp_path):
    log = str(tmp_path / "calls")
    good = json.dumps(GOOD)

    def model(texts):
        kinds = [t.split("\n")[0] for t in texts]
        with open(log, "a") as f:
            f.write("".join(k + "\n" for k in kinds))
        if "raises" in kinds:
            raise RuntimeError("busy")
        retried = ["Previous attempt failed validation: LLM response is None" in t for t in texts]
        return [good if k == "good" or k == "second" and r else ValueError("odd") if k == "odd" else "no" for k, r in zip(kinds, retried)]

    rows = [("1", "good"), ("2", "second"), ("3", "never"), ("4", "raises"), ("5", "odd")]
    asked = spark.createDataFrame(rows, "query_id string, prompt string").coalesce(1)
    done = generation.generation_rounds(asked, model)
    got = {r["query_id"]: r for r in done.collect()}
    # One prompt spoils the first list; from then on those of the list are sent alone.
    wanted = {"1": (2, True), "2": (2, True), "3": (3, False), "4": (3, False), "5": (3, False)}
    assert {k: (r["attempts"], r["passed"]) for k, r in got.items()} == wanted
    assert got["5"]["response_error"] == "odd"
    assert got["4"]["response_error"] == "busy" and got["4"]["generation_error"] == "LLM response is None"
    done.count()
    calls = open(log).read().split()
    assert sorted(calls) == sorted(["good"] * 2 + ["second"] * 2 + ["never"] * 3 + ["raises"] * 3 + ["odd"] * 3)

    final = {r["query_id"]: r for r in generation.results(done).collect()}
    assert final["1"]["root_cause_hypothesis"] == "h" and json.loads(final["1"]["raw_llm_response"]) == GOOD
    bad = final["3"]
    assert bad["root_cause_hypothesis"] == "Unable to generate analysis: LLM response is None"
    assert bad["recommended_actions"] == ["Investigate manually", "Check logs", "Review recent changes"]
    assert (bad["estimated_impact"], bad["analysis_summary"], bad["citations"], bad["raw_llm_response"]) == (
        "Unknown - requires manual assessment", "LLM analysis unavailable", [], None,
    )
    assert generation.build_results(done).count() == 2 and generation.fallback_results(done).count() == 3


def test_all_pass_in_one_round(spark):
    df = spark.createDataFrame([("1", "x")], "query_id string, prompt string")
    good = json.dumps(GOOD)
    assert generation.generation_rounds(df, lambda ts: [good] * len(ts)).first()["attempts"] == 1


def test_wrong_number_of_answers(spark):
    df = spark.createDataFrame([("1", "x")], "query_id string, prompt string")
    row = generation.respond(df, lambda ts: []).first()
    assert row["response"] is None and row["response_error"] == "0 answers for 1 prompts"


def test_system_prompt_is_handed_over(spark):
    df = spark.createDataFrame([("1", "x")], "query_id string, prompt string")
    row = generation.respond(df, lambda texts, system: [system] * len(texts)).first()
    assert row["response"] == generation.SYSTEM_PROMPT
    assert generation.respond(df, lambda texts: texts).first()["response"] == "x"


def test_analyze(spark):
    def model_vectors(texts):
        return [[float("disk" in t.lower()), float("dns" in t.lower()), 0.2] for t in texts]

    incidents = spark.createDataFrame(
        [(f"d{i}", f"disk {i}", "disk is full", "capacity", "high", "fixed") for i in range(6)] + [("n0", "dns", "dns fails", "network", "low", "")],
        "id string, title string, description string, category string, severity string, resolution string",
    )
    from triagelake.operators.embedding import embed_with

    vectors = embed_with(incidents.withColumn("text", F.col("title")), model_vectors).select("id", "vec")
    queries = spark.createDataFrame(
        [("a", "disk storage quota", "full, critical"), ("b", "dns proxy", "socket"), ("c", "zzz", "yyy")],
        "query_id string, title string, description string",
    )
    good = {**GOOD}

    def model(texts):
        return [json.dumps({**good, "citations": [{"incident_id": "d0"}]}) if "Similar Incident 1" in t else "no" for t in texts]

    got = {r["query_id"]: r for r in analyze(queries, incidents, vectors, model, embed_fn=model_vectors, threshold=0.9).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert (got["a"]["predicted_category"], got["a"]["predicted_severity"]) == ("capacity", "critical")
    assert [h["incident_id"] for h in got["a"]["similar_incidents"]] == [f"d{i}" for i in range(5)]
    assert [h["incident_id"] for h in got["b"]["similar_incidents"]] == ["n0"]
    assert got["a"]["citations"][0]["incident_id"] == "d0" and got["a"]["attempts"] == 1
    assert got["c"]["similar_incidents"] == [] and got["c"]["attempts"] == 3
    assert got["c"]["root_cause_hypothesis"].startswith("Unable to generate analysis")
    hit = got["b"]["similar_incidents"][0]
    assert (hit["description"], hit["resolution"], hit["similarity_score"]) == ("dns fails", "", 1.0)
    own = queries.withColumns({"top_k": F.lit(2), "similarity_threshold": F.lit(0.9)})
    few = {r["query_id"]: r for r in analyze(own, incidents, vectors, model, embed_fn=model_vectors, threshold=0.0).collect()}
    assert [h["incident_id"] for h in few["a"]["similar_incidents"]] == ["d0", "d1"]
    with pytest.raises(ValueError):
        analyze(queries, incidents, vectors, model)


def test_evaluation(spark, tmp_path):
    path = tmp_path / "cases.json"
    base = {"title": "t", "description": "d", "expected_category": "data", "expected_severity": "low", "expected_keywords": ["Disk", "zzz"], "should_cite_similar": True}
    path.write_text(json.dumps({"version": 1, "cases": [{**base, "id": "1"}, {**base, "id": "2", "expected_keywords": [], "should_cite_similar": False}, {**base, "id": "3"}]}, indent=1))
    cases = read_golden_cases(spark, str(path))
    item = F.struct(F.lit("x").alias("incident_id"))
    results = spark.createDataFrame(
        [("1", "data", "high", 0.5, "bad DISK", ["act"], "", 2.0), ("2", "data", "low", 1.0, "", [], "sum", 4.0)],
        "case_id string, predicted_category string, predicted_severity string, category_confidence double, "
        "root_cause_hypothesis string, recommended_actions array<string>, analysis_summary string, latency_seconds double",
    ).withColumns({"similar_incidents": F.array(item, item), "citations": F.array().cast("array<struct<incident_id:string>>")})
    per_case, summary = evaluation.evaluate(results, cases)
    rows = {r["case_id"]: r for r in per_case.collect()}
    assert (rows["1"]["category_correct"], rows["1"]["severity_correct"], rows["1"]["keyword_coverage"]) == (True, False, 0.5)
    assert (rows["1"]["has_required_citations"], rows["2"]["has_required_citations"]) == (False, True)
    assert rows["2"]["keyword_coverage"] == 1.0 and rows["2"]["has_actions"] is False
    assert rows["3"]["success"] is False and rows["3"]["error"] == "no result"
    s = summary.first()
    assert (s["total_cases"], s["successful_cases"], s["avg_latency_seconds"], s["avg_retrieved"]) == (3, 2, 3.0, 2.0)
    assert s["success_rate"] == pytest.approx(2 / 3) and s["category_accuracy"] == 1.0 and s["citation_rate"] == 0.5
    none = evaluation.evaluation_summary(evaluation.score_cases(results.limit(0), cases)).first()
    assert (none["success_rate"], none["category_accuracy"], none["error"]) == (0.0, 0.0, "All evaluations failed")
    write_metrics(summary, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    assert [r["case_id"] for r in evaluation.first_cases(cases, 2).collect()] == ["1", "2"]
