import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import ids
from triagelake.functions.vectors import dot, l2_normalize
from triagelake.operators import embedding, similarity
from triagelake.operators.blocks import BlockTopK
from triagelake.sources.vectors import read_vectors, vector_count, write_vectors


def brute(qids, q, cids, c, k, threshold, exclude_self=False):
    rows = []
    scores = np.array([[np.einsum("j,j->", a, b) for b in c.astype(np.float64)] for a in q.astype(np.float64)]).reshape(len(q), len(c))
    for i, qid in enumerate(qids):
        best = sorted((-scores[i, j], cid) for j, cid in enumerate(cids) if not (exclude_self and cid == qid))[:k]
        rows += [(qid, cid, round(-s, 6), r + 1) for r, (s, cid) in enumerate(best) if -s >= threshold]
    return sorted(rows)


def unit(rng, n, dim=16):
    v = rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, name, keys, vectors):
    return spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, vectors)], f"{name} string, vec array<float>")


def rows(df):
    return sorted((r["query_id"], r["incident_id"], r["score"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    c = unit(rng, 400)
    c[100:240] = c[3]  # a third of the corpus are copies of one vector
    q = np.vstack([unit(rng, 30), c[3:4], c[200:201]])
    cids = [f"inc-{i:03d}" for i in range(400)]
    qids = [f"q{i:02d}" for i in range(30)] + ["inc-003", "inc-200"]
    return qids, q, cids, c, frame(spark, "query_id", qids, q), frame(spark, "id", cids, c).repartition(5)


@pytest.mark.parametrize("k,threshold,exclude", [(5, 0.0, False), (1, 0.5, False), (5, -1.0, True), (500, 0.2, False)])
@pytest.mark.parametrize("blocks", [False, True])
def test_topk_is_exact(data, k, threshold, exclude, blocks):
    qids, q, cids, c, queries, corpus = data
    how = dict(query_bytes=700) if blocks else {}
    got = rows(similarity.topk_similar(queries, corpus, k, threshold, exclude, **how))
    assert got == brute(qids, q, cids, c, k, threshold, exclude)


@settings(max_examples=60, deadline=None)
@given(
    st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 60), st.integers(1, 8), st.integers(1, 12),
    st.sampled_from([-1.0, 0.0, 0.4]), st.booleans(),
)
def test_block_topk_property(seed, nq, nc, dim, k, threshold, exclude):
    """Coarse values make many equal scores; batches come in any size."""
    rng = np.random.default_rng(seed)
    q = rng.integers(-2, 3, size=(nq, dim)).astype(np.float32)
    c = rng.integers(-2, 3, size=(nc, dim)).astype(np.float32)
    qids, cids = [f"i{i}" for i in range(nq)], [f"i{i}" for i in rng.permutation(nc)]
    block = BlockTopK(pa.array(qids), q, np.full(nq, k), np.full(nq, threshold), exclude)
    at = 0
    while at < nc:
        step = int(rng.integers(1, nc + 1))
        block.add(pa.array(cids[at : at + step]), c[at : at + step])
        at += step
    schema = pa.schema([("query_id", pa.string()), ("incident_id", pa.string()), ("score", pa.float64()), ("_k", pa.int32())])
    got = block.result(schema).to_pylist()
    expected = [(a, b, s) for a, b, s, _ in brute(qids, q, cids, c, k, threshold, exclude)]
    assert sorted((r["query_id"], r["incident_id"], r["score"]) for r in got) == expected


def test_scores_equal_the_expression(data):
    _, _, _, _, queries, corpus = data
    hits = similarity.topk_similar(queries, corpus, 3)
    joined = hits.join(queries.withColumnRenamed("vec", "q"), "query_id").join(
        corpus.select(F.col("id").alias("incident_id"), F.col("vec").alias("c")), "incident_id"
    )
    assert joined.filter(F.abs(F.col("score") - dot("q", "c")) > 1e-6).count() == 0


def test_guards(spark, data):
    _, _, _, _, queries, corpus = data
    with pytest.raises(ValueError):
        similarity.topk_similar(queries, corpus, 0)
    with pytest.raises(Exception, match="differ in vector length"):
        similarity.topk_similar(frame(spark, "query_id", ["a"], np.ones((1, 3))), corpus).collect()
    assert similarity.topk_similar(queries.limit(0), corpus).count() == 0
    assert similarity.topk_similar(queries, corpus.limit(0)).count() == 0
    assert vector_count(corpus).first()["vectors"] == 400


def test_self_is_excluded(data):
    qids, q, cids, c, queries, corpus = data
    got = similarity.similar_to_incidents(corpus.filter("id < 'inc-010'"), corpus, 4)
    some = cids[:10]
    assert rows(got) == brute(some, c[:10], cids, c, 4, 0.0, True)


@pytest.mark.parametrize("k,threshold", [(5, 0.3), (3, 0.7), (1, 0.2), (4, 0.95)])
def test_relaxation_equals_two_searches(data, k, threshold):
    _, _, _, _, queries, corpus = data
    strict = rows(similarity.topk_similar(queries, corpus, k, threshold))
    easy = rows(similarity.topk_similar(queries, corpus, k + 5, max(0.0, threshold - 0.1)))
    counts = {}
    for r in strict:
        counts[r[0]] = counts.get(r[0], 0) + 1
    expected = [r for r in strict if counts[r[0]] >= 2] + [r for r in easy if counts.get(r[0], 0) < 2]
    got = similarity.retrieve_with_relaxation(queries, corpus, k, threshold)
    assert rows(got) == sorted(expected)
    assert {r["query_id"] for r in got.filter("attempts = 1").collect()} == {q for q, n in counts.items() if n >= 2}


@pytest.fixture(scope="module")
def incidents(spark, data):
    cids = data[2]
    kinds = ["latency", "outage", "data"]
    return spark.createDataFrame(
        [(c, f"title {c}", "text", kinds[i % 3], "high" if i % 2 else "low", f"2024-01-{i % 28 + 1:02d} 00:00:00", None) for i, c in enumerate(cids)],
        "id string, title string, description string, category string, severity string, created string, resolution string",
    ).withColumn("created_at", F.to_timestamp("created"))


def test_filtered_retrieval(data, incidents):
    qids, q, cids, c, queries, corpus = data
    kw = dict(categories=["data"], severities=["high"], after="2024-01-05")
    allowed = set(ids(incidents.filter("category = 'data' and severity = 'high' and created_at >= '2024-01-05'")))
    keep = [i for i, x in enumerate(cids) if x in allowed]
    pre = similarity.retrieve(queries, incidents, corpus, 5, 0.1, **kw)
    assert rows(pre) == brute(qids, q, [cids[i] for i in keep], c[keep], 5, 0.1)
    rich = corpus.join(incidents.select("id", "category", "severity", "created_at"), "id")
    assert rows(similarity.retrieve(queries, incidents, rich, 5, 0.1, **kw)) == rows(pre)
    over = similarity.retrieve(queries, incidents, corpus, 5, 0.1, mode="overfetch", **kw)
    pairs = {(r[0], r[1], r[2]) for r in rows(pre)}
    assert {(r[0], r[1], r[2]) for r in rows(over)} <= pairs
    wide = brute(qids, q, cids, c, 15, 0.1)
    expected = {}
    for qid, cid, s, _ in sorted(wide, key=lambda r: (r[0], r[3])):
        if cid in allowed and len(expected.setdefault(qid, [])) < 5:
            expected[qid].append((qid, cid, s, len(expected[qid]) + 1))
    assert rows(over) == sorted(r for rs in expected.values() for r in rs)
    assert similarity.retrieve(queries, incidents, corpus, 5, 0.0, categories=[]).count() == 0
    with pytest.raises(ValueError):
        similarity.retrieve(queries, incidents, corpus, mode="other")


def test_missing_incidents_are_dropped_without_refill(data, incidents):
    qids, q, cids, c, queries, corpus = data
    some = incidents.filter("id >= 'inc-050'")
    got = rows(similarity.retrieve(queries, some, corpus, 5, 0.0))
    assert got == [r for r in brute(qids, q, cids, c, 5, 0.0) if r[1] >= "inc-050"]


def test_search_with_own_terms(data, incidents):
    qids, q, cids, c, queries, corpus = data
    requests = queries.withColumn("top_k", F.length("query_id")).withColumn("threshold", F.lit(0.35))
    got, _ = similarity.search(requests, incidents, corpus)
    assert got.columns == ["query_id", "rank", "incident_id", "title", "category", "severity", "similarity_score"]
    expected = [r for i, x in enumerate(qids) for r in brute([x], q[i : i + 1], cids, c, len(x), 0.35)]
    assert sorted((r["query_id"], r["incident_id"], r["similarity_score"], r["rank"]) for r in got.collect()) == sorted(expected)


def test_scores_are_clamped(spark, incidents):
    queries = frame(spark, "query_id", ["q"], np.array([[1.1, 0.0]]))
    corpus = frame(spark, "id", ["inc-001"], np.array([[1.0, 0.0]]))
    assert similarity.retrieve(queries, incidents, corpus).first()["score"] == 1.0


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r["u"] for r in df.select(l2_normalize("v").alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_embedding(spark, incidents, tmp_path):
    texts = incidents.withColumn("description", F.concat(F.lit("disk number "), F.col("id")))
    vectors, embedder = embedding.build_vectors(texts, dim=4096)
    assert vectors.columns == ["id", "category", "severity", "created_at", "vec"]
    assert vectors.count() == 400
    norms = vectors.select(F.sqrt(dot("vec", "vec")).alias("n"))
    assert norms.filter("abs(n - 1) > 1e-5 and n > 0").count() == 0
    query = spark.createDataFrame([("q", "title inc-007 disk number inc-007")], "query_id string, text string")
    best = similarity.topk_similar(embedding.embed(query, embedder), vectors, 1, 0.3).first()
    assert best["incident_id"] == "inc-007"
    write_vectors(vectors, str(tmp_path / "v"))
    assert vector_count(read_vectors(spark, str(tmp_path / "v"))).first()["vectors"] == 400
    with pytest.raises(Exception):
        read_vectors(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="need at least 1"):
        embedding.build_vectors(incidents.limit(0))


def test_callers_model(spark):
    df = spark.createDataFrame([("a b",), ("",)], "text string")
    got = embedding.embed_with(df, lambda ts: [[float(len(t)), 0.0] for t in ts], batch_size=1)
    assert [r["vec"] for r in got.collect()] == [[1.0, 0.0], [0.0, 0.0]]


def test_every_request_gets_what_it_asks_for(spark, data, incidents):
    qids, q, cids, c, queries, corpus = data
    terms = [(50, 0.0), (51, 0.0), (0, 0.0), (3, -0.1), (4, 1.5), (None, None), (40, 0.1)]
    asked = spark.createDataFrame([(qids[i], k, t) for i, (k, t) in enumerate(terms)], "query_id string, top_k int, threshold double")
    found, rejected = similarity.search(queries.join(asked, "query_id"), incidents, corpus)
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    for i, (k, t) in {0: (50, 0.0), 5: (10, 0.0), 6: (40, 0.1)}.items():
        assert counts[qids[i]] == len(brute([qids[i]], q[i : i + 1], cids, c, k, t))
    reasons = {r["query_id"]: r["errors"] for r in rejected.collect()}
    assert reasons == {
        qids[1]: ["top_k must be 1 to 50"], qids[2]: ["top_k must be 1 to 50"],
        qids[3]: ["threshold must be 0.0 to 1.0"], qids[4]: ["threshold must be 0.0 to 1.0"],
    }


def test_filters_of_requests(spark, data, incidents):
    qids, q, cids, c, queries, corpus = data
    own = [
        (["data"], None, None, None), ([], None, None, None), (None, ["high"], None, None), (None, None, "2024-01-20", None),
        (["latency", "outage"], ["low"], "2024-01-03", "2024-01-10"), (None, None, None, None),
    ]
    schema = "query_id string, categories array<string>, severities array<string>, after string, before string"
    asked = spark.createDataFrame([(qids[i], *o) for i, o in enumerate(own)], schema).withColumn("top_k", F.lit(7))
    found, _ = similarity.search(queries.join(asked, "query_id"), incidents, corpus)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["incident_id"]))
    facts = {r["id"]: r for r in incidents.collect()}
    for i, (cats, sevs, after, before) in enumerate(own):
        keep = [
            j for j, x in enumerate(cids)
            if (cats is None or facts[x]["category"] in cats) and (sevs is None or facts[x]["severity"] in sevs)
            and (after is None or facts[x]["created"] >= f"{after} 00:00:00") and (before is None or facts[x]["created"] <= f"{before} 00:00:00")
        ]
        want = [(r, x) for _, x, _, r in brute([qids[i]], q[i : i + 1], [cids[j] for j in keep], c[keep].reshape(-1, 16), 7, 0.0)]
        assert sorted(got.get(qids[i], [])) == sorted(want)


def test_floors_from_a_sample_change_nothing(data, monkeypatch):
    qids, q, cids, c, queries, corpus = data
    monkeypatch.setattr(similarity, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(similarity, "SAMPLE_FROM", 2)
    assert rows(similarity.topk_similar(queries, corpus, 5, 0.1, True)) == brute(qids, q, cids, c, 5, 0.1, True)


def test_scores_are_compared_unrounded(spark):
    queries = frame(spark, "query_id", ["q"], np.array([[1.0, 0.0]]))
    corpus = spark.createDataFrame([("a", [0.29999989, 0.0]), ("b", [0.30000001, 0.0])], "id string, vec array<float>")
    assert [r["incident_id"] for r in similarity.topk_similar(queries, corpus, 2, 0.3).collect()] == ["b"]
    assert [r["incident_id"] for r in similarity.topk_similar(queries, corpus, 1).collect()] == ["b"]


def test_the_model_is_asked_once_per_text(spark, incidents, tmp_path):
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.write("x\n" * len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    twice = incidents.unionByName(incidents.withColumn("created_at", F.col("created_at") - F.expr("interval 1 day")))
    vectors, _ = embedding.build_vectors(twice, fn=model)
    vectors.write.parquet(str(tmp_path / "vectors"))
    assert len(open(log).read().split()) == 400
    queries = embedding.embed_with(incidents.select(F.col("id").alias("query_id"), F.col("title").alias("text")), model)
    similarity.topk_similar(queries, read_vectors(spark, str(tmp_path / "vectors")), 2, query_bytes=2000).collect()
    assert len(open(log).read().split()) == 800
