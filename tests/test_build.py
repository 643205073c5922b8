import pytest
from pyspark.sql import functions as F

from conftest import ids
from triagelake.operators import similarity, synth
from triagelake.operators.embedding import embed
from triagelake.plans.build import build_tables
from triagelake.plans.search import retrieve_for_incidents, search_texts
from triagelake.session import cut, shared_dir, temporary
from triagelake.sources.incidents import read_incident_table
from triagelake.sources.vectors import read_vectors


def test_build_and_search(spark, tmp_path):
    first = synth.generate_incidents(spark, 200, as_of="2024-06-01")
    second = first.withColumn("id", F.concat(F.lit("copy-"), "id")).withColumn("title", F.upper("title"))
    out = str(tmp_path)
    stats, embedder = build_tables(spark, [(0, first), (1, second)], out, dim=256)
    incidents, vectors = read_incident_table(spark, f"{out}/incidents"), read_vectors(spark, f"{out}/vectors")
    n = incidents.count()
    assert 0 < n <= 200 and vectors.count() == n
    # Statistics are of all current versions, before titles are deduplicated.
    assert stats.filter("dimension = 'total'").first()["incidents"] == 400
    assert not [i for i in ids(incidents) if i.startswith("copy-")]
    query = spark.createDataFrame([("q", "lost dns after a router change")], "query_id string, text string")
    found = similarity.retrieve(embed(query, embedder), incidents, vectors, 3, 0.0, categories=["network"])
    assert {r["category"] for r in found.collect()} == {"network"}

    requests = spark.createDataFrame([("a", "lost dns after a router change", 2), ("b", "", 3), ("c", "q", 51)], "query_id string, query string, top_k int")
    hits, rejected = search_texts(requests, incidents, vectors, embedder, severities=["low", "medium"])
    rows = hits.collect()
    assert 0 < len(rows) <= 2 and {r["severity"] for r in rows} <= {"low", "medium"}
    assert ids(rejected, "query_id") == ["b", "c"]

    some = incidents.limit(5)
    best = retrieve_for_incidents(some, incidents, vectors, 1, 0.0, embedder).collect()
    titles = {r["id"]: r["title"] for r in some.collect()}
    assert len(best) == 5 and all(r["score"] > 0.999 and r["title"] == titles[r["query_id"]] for r in best)


def test_helpers(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = cut(spark.range(5).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    with temporary(spark):
        gone = cut(spark.range(3))
        assert gone.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(gone.inputFiles()[0])
    assert df.count() == 5


def test_only_one_machine_may_lack_a_shared_folder():
    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)
            self.conf = {}

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))


def test_one_row_per_id(spark, tmp_path):
    """Versions of an id with other titles: the last stays, so k hits are k incidents."""
    made = synth.generate_incidents(spark, 60, as_of="2024-06-01")
    later = made.withColumns(
        {"title": F.concat(F.lit("later "), "title"), "created_at": F.col("created_at") + F.expr("interval 1 hour")}
    )
    stats, embedder = build_tables(spark, [(0, made), (1, later), (2, made)], str(tmp_path), dedupe=False, dim=64)
    incidents, vectors = read_incident_table(spark, f"{tmp_path}/incidents"), read_vectors(spark, f"{tmp_path}/vectors")
    assert incidents.count() == vectors.count() == 60
    assert incidents.where("not startswith(title, 'later ')").count() == 0
    assert stats.where("dimension = 'total'").first()["incidents"] == 60
    found = retrieve_for_incidents(incidents, incidents, vectors, 3, -1.0, embedder)
    assert found.groupBy("query_id").count().where("count <> 3").count() == 0


@pytest.mark.parametrize("name", ["localCheckpoint", "crossJoin", "toPandas"])
def test_package_keeps_off(name):
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "triagelake"
    assert not [p for p in root.rglob("*.py") if name in p.read_text()]


def test_every_document_asks(spark, tmp_path):
    from checks.search import for_incidents

    rows = [(i, f"word{i} word{i + 1} other{i * 7}", "en", "web", 20) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = for_incidents(spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["incident_id"]) for r in found if r["rank"] == 1} == {(f"doc-{i}",) * 2 for i in range(120)}
