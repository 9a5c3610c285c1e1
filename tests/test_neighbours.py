"""The index of vectors against a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import vectors as V
from tesserine.operators import neighbours
from tesserine.plans import catalogue
from tesserine.tables import read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Groups of one direction each, one with a third of all vectors, and rows without a cosine."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(40, 24))
    group = np.where(r.random(6000) < 1 / 3, 0, r.integers(0, 40, 6000))
    rows = [(i, v.tolist()) for i, v in enumerate((middle[group] + 0.35 * r.normal(size=(6000, 24))).astype(np.float32))]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [1.0] * 23), (9003, [float("nan")] * 24), (9004, [None] + [1.0] * 23), (None, [1.0] * 24), (9005, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<float>").repartition(4)
    return df, rows, neighbours.build(df, str(tmp_path_factory.mktemp("index") / "v"), 24)


def test_every_usable_row_is_indexed(clustered):
    assert clustered[2].rows.count() == 6000 and {r["id"] for r in clustered[2].rows.select("id").collect()} == set(range(6000))


def test_tuned_recall_and_bytes(clustered):
    df, rows, index = clustered
    queries = [rows[i] for i in range(7, 6000, 100)]
    probes = neighbours.tune(index, 10, 0.98)
    assert probes < len(index.centroids) / 2
    wanted = neighbours.exact(neighbours.usable(df, 24), queries, 10)
    assert neighbours.recall(neighbours.search(index, queries, 10, probes), wanted) >= 0.95
    shares = neighbours.read_share(index, queries, 10, probes).collect()
    assert len(shares) == len(queries) and np.mean([s["bytes_share"] for s in shares]) < 0.35


def test_all_cells_give_the_hits_of_a_scan(clustered, monkeypatch):
    df, rows, index = clustered
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    queries = [rows[i] for i in range(0, 6000, 800)]
    hits = [tuple(x)[:3] for x in neighbours.search(index, queries, 5, len(index.centroids)).orderBy("query", "rank").collect()]
    assert hits == [tuple(x)[:3] for x in neighbours.exact(neighbours.usable(df, 24), queries, 5).orderBy("query", "rank").collect()]
    table = neighbours.usable(df, 24).filter("id % 800 = 0")
    assert hits == [tuple(x)[:3] for x in neighbours.search(index, table, 5, len(index.centroids)).orderBy("query", "rank").collect()]


def test_a_probe_reads_its_cells_and_no_vectors(spark, clustered):
    _, rows, index = clustered
    q = np.array([rows[0][1]])
    plan = neighbours._candidates(index, [0], q, index.cells_of(q, 2), 5)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [cell" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_recall_on_the_table(spark):
    r = catalogue.knn_recall(spark, SF).first()
    assert r["recall"] >= 0.95 and r["queries"] == read(spark, SF, "embeddings").filter("vec_id % 20 = 0").count()


def test_no_vectors(spark, tmp_path):
    index = neighbours.build(spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path / "v"), 4)
    assert neighbours.search(index, [(1, [1.0, 0, 0, 0])], 3, 1).count() == 0 and neighbours.tune(index, 3, 0.9) == 1


def test_a_scan_gives_the_cosines_of_the_expression(spark, monkeypatch):
    """Equal vectors in many tasks and chunks, ties by id, scores to the last bit."""
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    monkeypatch.setattr(neighbours, "PAIRS", 5)
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([r.normal(size=(90, 9)), np.repeat(r.normal(size=(2, 9)), 40, 0), 1e-20 * r.normal(size=(10, 9))]).astype(np.float32))]
    df = neighbours.usable(spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5), 9)
    queries = rows[::12]
    got = sorted(map(tuple, neighbours.exact(df, queries, 6).collect()))
    pairs = df.crossJoin(neighbours._asked(spark, queries)).select("q", "id", V.cosine(F.col("embedding"), F.col("query")).alias("score")).collect()
    want = [(q, n + 1, i, s) for q, _ in queries for n, (s, i) in enumerate(sorted(((-x["score"], x["id"]) for x in pairs if x["q"] == q))[:6])]
    assert got == sorted((q, n, i, -s) for q, n, i, s in want)


def test_a_scan_pairs_no_rows(spark):
    df = neighbours.usable(spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>"), 2)
    plan = neighbours.exact(df, [(1, [1.0, 0.0])], 1)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan
