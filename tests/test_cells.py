import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_similarity import brute, frame, rows, unit
from triagelake.operators import cells, similarity


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Tight clusters of several lengths, one of them a third of the corpus and mostly copies."""
    rng = np.random.default_rng(8)
    centers = unit(rng, 12)
    c = np.vstack([centers[i % 12] + rng.normal(size=16) * 0.02 for i in range(600)]) * rng.choice([0.5, 1.0, 2.0], size=(600, 1))
    c[:200] = c[5]
    c = c.astype(np.float32)
    q = np.vstack([centers + rng.normal(size=(12, 16)) * 0.05, -centers[:2], np.zeros((1, 16))]).astype(np.float32)
    cids, qids = [f"inc-{i:03d}" for i in range(600)], [f"q{i:02d}" for i in range(14)] + ["inc-005"]
    q[14] = c[5]
    corpus = frame(spark, "id", cids, c).withColumn("category", F.lit("data")).repartition(4)
    path = str(tmp_path_factory.mktemp("cells"))
    cells.write_cells(corpus, path, 12)
    return qids, q, cids, c, frame(spark, "query_id", qids, q), corpus, path


@pytest.mark.parametrize("k,threshold,exclude", [(5, 0.0, False), (1, 0.5, False), (3, -9.0, True), (250, 0.2, False)])
@pytest.mark.parametrize("small", [False, True])
def test_rows_equal_the_full_search(spark, data, monkeypatch, k, threshold, exclude, small):
    qids, q, cids, c, queries, corpus, path = data
    if small:
        monkeypatch.setattr(cells, "SLICE_ROWS", 40)
        monkeypatch.setattr(cells, "BLOCK_ROWS", 3)
    got = rows(cells.topk_in_cells(queries, *cells.read_cells(spark, path), k, threshold, exclude))
    assert got == brute(qids, q, cids, c, k, threshold, exclude)
    assert got == rows(similarity.topk_similar(queries, corpus, k, threshold, exclude))


def test_cells_that_cannot_matter_are_left_unread(spark, data):
    *_, queries, corpus, path = data
    vectors, table = cells.read_cells(spark, path)
    said = cells.pruning(queries.where("query_id < 'q12' and query_id >= 'q'"), vectors, table, 3, 0.6).first()
    assert (said["queries"], said["vectors"], said["pairs"]) == (12, 600, 7200) and said["scored"] < 0.6 * said["pairs"]
    alone = queries.where("query_id = 'q03'")
    assert cells.pruning(alone, vectors, table, 1, 0.9).first()["cells_read"] <= 3
    # Only the folders of cells that are met are in the scan.
    plan = cells.topk_in_cells(alone, vectors, table, 250, 0.2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan)


def test_bounds_hold(data, spark):
    _, q, cids, c, _, _, path = data
    vectors, table = cells.read_cells(spark, path)
    known = table.collect()
    bound = cells.CellBounds(known).of(q.astype(np.float64))
    cell_of = {r["id"]: r["cell"] for r in vectors.collect()}
    place = {r["cell"]: i for i, r in enumerate(known)}
    scores = q.astype(np.float64) @ c.astype(np.float64).T
    for j, cid in enumerate(cids):
        assert (scores[:, j] <= bound[:, place[cell_of[cid]]]).all()
    assert vectors.columns == ["id", "vec", "category", "_apart", "cell"] and vectors.count() == 600 == sum(r["rows"] for r in known)


def test_few_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vec array<float>")
    queries = frame(spark, "query_id", ["a", "b"], unit(np.random.default_rng(1), 2))
    cells.write_cells(none, str(tmp_path / "none"))
    assert cells.topk_in_cells(queries, *cells.read_cells(spark, str(tmp_path / "none"))).count() == 0
    one = queries.limit(1).withColumnRenamed("query_id", "id")
    cells.write_cells(one, str(tmp_path / "one"))
    held = cells.read_cells(spark, str(tmp_path / "one"))
    assert rows(cells.topk_in_cells(queries, *held, 3, -1.0)) == rows(similarity.topk_similar(queries, one, 3, -1.0))
    assert cells.topk_in_cells(queries.limit(0), *held).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        cells.topk_in_cells(queries, *held, 0)
