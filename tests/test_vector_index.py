import random

import numpy as np
import pytest

from threadloom.functions import vectors as V
from threadloom.operators import vector_index
from threadloom.operators.vector_index import VectorIndex


def clustered(n, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim)) * 4
    return [(int(i), (centres[i % 12] + r.normal(size=dim)).tolist(), f"g{i % 3}") for i in range(n)]


SCHEMA = "id long, embedding array<double>, kind string"


def found(df):
    return [(r.id, round(r.dist, 12)) for r in df.orderBy("dist", "id").collect()]


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(9000, None, "x"), (9001, [1.0], "x"), (9002, [float("nan")] * 8, "x"), (9003, [None] + [0.0] * 7, "x"), (9004, [0.0] * 8, "x")]
    ties = [(8000 + i, [0.5] * 8, "t") for i in range(6)]
    return spark.createDataFrame(clustered(1500) + odd + ties, SCHEMA).repartition(3).persist()


def test_equal_to_a_scan_and_reads_less(spark, rows):
    index = VectorIndex.build(rows, "id", "embedding", 8, carry=("kind",))
    shares = []
    for q, k in ((clustered(20)[7][1], 10), ([0.5] * 8, 3), ([0.0] * 8, 25), ([100.0] * 8, 5)):
        assert found(index.knn(q, k)) == found(V.knn(rows, "id", "embedding", q, k)), (q, k)
        shares.append(index.scanned(q, k))
    assert min(shares) < 0.3
    assert index.knn([0.5] * 8, 1).columns == ["id", "kind", "dist"]
    assert len(index.knn([0.5] * 8, 5000).collect()) == 1506
    with pytest.raises(ValueError, match="expected 8"):
        index.knn([1.0], 3)


def test_updates(spark, rows):
    index = VectorIndex.build(rows, "id", "embedding", 8)
    fresh = spark.createDataFrame([(i, v, "n") for i, v, _ in clustered(100, seed=5)] + [(7000, [0.51] * 8, "n")], SCHEMA)
    grown = index.update(fresh, "embedding", spark.createDataFrame([(8000,), (8001,), (77777,)], "id long"))
    now = rows.join(fresh.select("id"), "id", "left_anti").where("id NOT IN (8000, 8001)").unionByName(fresh)
    for q in ([0.5] * 8, clustered(20)[3][1]):
        assert found(grown.knn(q, 12)) == found(V.knn(now, "id", "embedding", q, 12))
        assert found(index.knn(q, 12)) == found(V.knn(rows, "id", "embedding", q, 12))
        assert found(grown.compact().knn(q, 12)) == found(V.knn(now, "id", "embedding", q, 12))
    gone = grown.update(deleted=now.select("id"))
    assert gone.knn([0.5] * 8, 3).count() == 0


def test_many_queries_equal_single_ones(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 40)
    index = VectorIndex.build(rows, "id", "embedding", 8).update(spark.createDataFrame([(8000, [3.0] * 8, "n")], SCHEMA), "embedding")
    r = random.Random(3)
    asked = [(f"q{i}", [r.gauss(0, 3) for _ in range(8)]) for i in range(12)] + [("tie", [0.5] * 8), ("bad", [1.0]), ("none", None)]
    many = index.knn_many(spark.createDataFrame(asked, "question string, vector array<double>"), 7).collect()
    for name, q in asked[:13]:
        want = [(x.id, x.dist) for x in index.knn(q, 7).orderBy("dist", "id").collect()]
        assert [(x.id, x.dist) for x in sorted((x for x in many if x.question == name), key=lambda x: x.rank)] == want, name
    assert {x.question for x in many} == {n for n, _ in asked[:13]}


def test_empty(spark):
    none = VectorIndex.build(spark.createDataFrame([], SCHEMA), "id", "embedding", 8)
    assert none.knn([0.0] * 8, 3).count() == 0
    assert none.update(spark.createDataFrame([(1, [1.0] * 8, "k")], SCHEMA), "embedding").knn([0.0] * 8, 3).count() == 1
