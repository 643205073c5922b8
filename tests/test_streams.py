import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import streams as streams_of_tables
from triagelake.operators import similarity
from triagelake.operators.classify import classify
from checks.tables import document_incidents
from triagelake.sources.incidents import write_incidents
from triagelake.streaming import streams


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def put(spark, rows, schema, path):
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 3)):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_classify_equals_batch(spark, tmp_path):
    schema = "id string, title string, description string"
    rows = [(str(i), t, "for all users" if i % 2 else "x") for i, t in enumerate(["slow api", "dns fails", "nothing", "disk full", "release"] * 3)]
    path = str(tmp_path / "in")
    put(spark, rows, schema, path)
    judged = streams.classify_stream(stream_of(spark, path, schema))
    finish(judged.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = classify(spark.read.parquet(path))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def incident(i, title, day, **more):
    return json.dumps({"id": i, "title": title, "description": "d", "source": "manual", "created_at": f"2024-06-{day:02d}T00:00:00Z", **more})


def write_to(stream, folder, name):
    return stream.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"cp-{name}"))


def arrived(spark, folder):
    return sorted((r["id"], r["title"], r["change"], r["version"]) for r in spark.read.parquet(str(folder / "out")).collect())


def test_ingest_sets_bad_rows_aside(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    source, refused = streams.ingest_stream(spark, str(folder))
    (folder / "1.jsonl").write_text("\n".join([incident("a", "first", 1), "", incident("x", "bad", 1, category="weather"), "{"]))
    finish(write_to(source, tmp_path, "out"))
    finish(write_to(refused, tmp_path, "refused"))
    assert arrived(spark, tmp_path) == [("a", "first", "new", 1)]
    bad = spark.read.parquet(str(tmp_path / "refused"))
    assert sorted(r["errors"][0] for r in bad.collect()) == ["invalid category: weather", "malformed record"]
    assert not {"_digest", "_place"} & set(bad.columns)
    strict, _ = streams.ingest_stream(spark, str(folder), mode="failfast")
    with pytest.raises(Exception, match="invalid category|malformed"):
        finish(write_to(strict, tmp_path, "strict"))
    with pytest.raises(ValueError, match="unknown mode"):
        streams.ingest_stream(spark, str(folder), mode="x")
    with pytest.raises(ValueError, match="span of time"):
        streams.ingest_stream(spark, str(folder), remember="a while")


def test_ingest_takes_the_last_version_whatever_its_date(spark, tmp_path):
    """One file a trigger: dates go back, versions come again, ids repeat inside a file."""
    folder = tmp_path / "in"
    folder.mkdir()
    files = [
        [incident("a", "one", 10), incident("b", "only", 10)],
        [incident("c", "late", 10), incident("a", "two", 9), incident("a", "three", 1)],
        [incident("d", "very late", 1), incident("b", "only", 10), incident("a", "three", 1)],
        [incident("a", "one", 10), incident("b", "other", 10), incident("b", "only", 10), incident("e", "x", 2), incident("e", "x", 2)],
    ]
    wanted, held = [], {}
    for i, lines in enumerate(files):  # the brute-force version: a dictionary that is written to line by line
        (folder / f"{i}.jsonl").write_text("\n".join(lines))
        os.utime(folder / f"{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
        last = {json.loads(x)["id"]: n for n, x in enumerate(lines)}
        for n, x in enumerate(lines):
            key, title = json.loads(x)["id"], json.loads(x)["title"]
            if last[key] != n:
                wanted.append((key, title, "overtaken", None))
                continue
            text, version = held.get(key, (None, 0))
            change = "new" if text is None else "unchanged" if text == x else "changed"
            held[key] = (x, version + (text != x))
            wanted.append((key, title, change, held[key][1]))
    stream, _ = streams.ingest_stream(spark, str(folder), max_files=1)
    writer = write_to(stream, tmp_path, "out").trigger(availableNow=True).start()
    writer.awaitTermination()
    assert len([p for p in writer.recentProgress if p["numInputRows"]]) == 4
    assert sorted(arrived(spark, tmp_path), key=repr) == sorted(wanted, key=repr)
    now = streams.current_versions(spark.read.parquet(str(tmp_path / "out")))
    assert {r["id"]: r["title"] for r in now.collect()} == {k: json.loads(x)["title"] for k, (x, _) in held.items()}
    assert "change" not in now.columns and now.count() == 5


def test_ingest_of_a_crowded_id(spark, tmp_path):
    """An id that fills a batch over several files: one row is its version, all others are overtaken."""
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(4):
        (folder / f"{f}.jsonl").write_text("\n".join(incident("hot", f"t{f}.{n}", 1 + n % 20) for n in range(300)))
        os.utime(folder / f"{f}.jsonl", (1_700_000_000 + f, 1_700_000_000 + f))
    stream, _ = streams.ingest_stream(spark, str(folder))
    finish(write_to(stream, tmp_path, "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["change"], r["version"]): r["n"] for r in got.groupBy("change", "version").agg(F.count("*").alias("n")).collect()} == {
        ("new", 1): 1, ("overtaken", None): 1199,
    }
    assert streams.current_versions(got).first()["title"] == "t3.299"


def test_ids_are_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.jsonl").write_text(incident("a", "same", 1))
        stream, _ = streams.ingest_stream(spark, str(folder), remember="1 second")
        finish(write_to(stream, tmp_path, "out"))
        time.sleep(2)
    assert arrived(spark, tmp_path) == [("a", "same", "new", 1)] * 2


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 8))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(f"d{i}", v[i].tolist()) for i in range(40)], "id string, vec array<float>")
    incidents = vectors.select(
        "id", F.concat(F.lit("t "), "id").alias("title"), F.lit("x").alias("description"), F.lit("data").alias("category"),
        F.lit("low").alias("severity"), F.lit("").alias("resolution"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    return v, vectors, incidents


def test_search_equals_batch_and_reruns_leave_no_duplicates(spark, tmp_path, base):
    v, vectors, incidents = base
    schema = "query_id string, vec array<float>, top_k int, threshold double"
    rows = [(f"q{i}", (v[i] + v[i + 1]).tolist(), 1 + i % 4, 0.2) for i in range(9)]
    path = str(tmp_path / "in")
    put(spark, rows, schema, path)
    out = str(tmp_path / "out")
    for run in ("cp1", "cp2"):  # the second run repeats all batches, as after a lost checkpoint
        finish(streams.search_stream(stream_of(spark, path, schema), incidents, vectors, out, str(tmp_path / run)))
    got = spark.read.parquet(out).drop("batch_id")
    batch = similarity.search(spark.read.parquet(path), incidents, vectors)[0].withColumn("error", F.lit(None).cast("string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    out2 = str(tmp_path / "out2")
    finish(streams.similar_stream(stream_of(spark, path, schema), incidents, vectors, out2, str(tmp_path / "cp3"), 2, 0.1))
    assert spark.read.parquet(out2).groupBy("query_id").count().filter("count > 2").count() == 0


def test_search_by_text(spark, tmp_path, base):
    _, vectors, incidents = base
    schema = "query_id string, query string"
    path = str(tmp_path / "in")
    put(spark, [("a", "x"), ("b", ""), ("c", "yy")], schema, path)
    out = str(tmp_path / "out")
    model = lambda ts: [[1.0] + [0.0] * 7 for _ in ts]
    finish(streams.search_stream(stream_of(spark, path, schema), incidents, vectors, out, str(tmp_path / "cp"), embed_fn=model))
    got = spark.read.parquet(out)
    assert got.filter("query_id = 'b'").first()["error"] == "query must be 1 to 5000 characters"
    assert got.filter("query_id = 'a'").count() == got.filter("query_id = 'c'").count() == 10


def test_analyze_marks_bad_rows(spark, tmp_path, base):
    v, vectors, incidents = base
    schema = "query_id string, title string, description string, vec array<float>"
    rows = [("ok", "dns", "fails", v[0].tolist()), ("bad", "", "fails", v[1].tolist()), ("ok2", "disk", "full", v[2].tolist())]
    path = str(tmp_path / "in")
    put(spark, rows, schema, path)
    answer = json.dumps({"root_cause_hypothesis": "h", "recommended_actions": [], "estimated_impact": "i", "analysis_summary": "s"})
    out = str(tmp_path / "out")
    finish(
        streams.analyze_stream(stream_of(spark, path, schema), incidents, vectors, lambda ts: [answer] * len(ts), out, str(tmp_path / "cp"))
    )
    got = {r["query_id"]: r for r in spark.read.parquet(out).collect()}
    assert {k: r["success"] for k, r in got.items()} == {"ok": True, "ok2": True, "bad": False}
    assert got["bad"]["error"] == "title must be 1 to 500 characters"
    assert got["ok"]["root_cause_hypothesis"] == "h" and got["ok"]["similar_incidents"][0]["incident_id"] == "d0"


@pytest.mark.parametrize("files", [0, 3])
def test_tables_stream_from_a_file_and_from_a_folder(spark, tmp_path, files):
    rows = [(i, f"text {i}") for i in range(9)]
    written, held = tmp_path / "written", tmp_path / "tables" / "things.parquet"
    spark.createDataFrame(rows, "id long, text string").repartition(max(files, 1)).write.parquet(str(written))
    held.parent.mkdir()
    parts = sorted(written.glob("part-*"))
    if files:
        held.mkdir()
    for i, part in enumerate(parts):
        part.rename(held / f"part-{i:04d}.parquet" if files else held)
    (tmp_path / "tables" / "others.parquet").write_bytes(b"no table")
    out = str(tmp_path / "out")
    stream = streams_of_tables.table_stream(spark, str(tmp_path / "tables"), "things")
    finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    assert sorted(map(tuple, spark.read.schema("id long, text string").parquet(out).collect())) == rows


def test_lengths_of_incidents_come_without_a_shuffle_of_texts(spark, tmp_path):
    rows = [(1, "a", "en", "x", 4), (2, "b", "fr", "x", 5), (2, "c", "de", None, None), (3, None, "en", "x", None), (None, "d", "en", "x", 8), (2, "b", "fr", "x", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sized = streams_of_tables.sized_incidents(spark, str(tmp_path))
    lengths = spark.createDataFrame([(f"doc-{r[0]}", r[4]) for r in rows if r[0] is not None], "id string, n_chars long")
    joined = document_incidents(spark, str(tmp_path)).join(lengths, "id")
    assert sorted(map(str, sized.select(joined.columns).collect())) == sorted(map(str, joined.collect())) and sized.count() == 11
    plan = sized._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_packed_incident_files_are_streamed(spark, tmp_path):
    rows = [("a", "t", "d" * 2000, "manual"), ("b", "t", "e" * 2000, "manual")]
    df = spark.createDataFrame(rows, "id string, title string, description string, source string").withColumn("metadata", F.lit("{}"))
    write_incidents(df.coalesce(1), str(tmp_path / "in"), "json", "gzip")
    assert sum(p.stat().st_size for p in (tmp_path / "in").glob("*.json.gz")) < 1000
    source, _ = streams.ingest_stream(spark, str(tmp_path / "in"), pattern="*.json.gz")
    finish(write_to(source, tmp_path, "out"))
    assert arrived(spark, tmp_path) == [("a", "t", "new", 1), ("b", "t", "new", 1)]
