import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as v
from lodestone.operators import ann, knn
from lodestone.plans.config import IndexConfig

DIM = 24


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def asking(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "query_id long, query array<float>")


def unit(seed, n, dim=DIM):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_config():
    assert IndexConfig(m=8).m0 == 16
    for bad in ({"m": 0}, {"m": 1}, {"ef_search": 0}, {"space": "euclidean"}, {"dim": True}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    assert IndexConfig.loads(IndexConfig(dim=8).dumps()).dim == 8
    with pytest.raises(ValueError):
        IndexConfig.loads(IndexConfig(dim=128).dumps(), 384)
    with pytest.raises(ValueError):
        IndexConfig.loads("{}")


def test_scalars(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(v.cosine_distance(a, b), v.l2_squared(a, b), v.l2_normalize(a)).collect()
    assert [round(r[0], 9) for r in got] == [0, 1, 2] and [r[1] for r in got] == [0, 1, 9]
    assert got[0][2] == pytest.approx([0.6, 0.8]) and got[1][2] == [0, 0]
    bad = spark.createDataFrame([([1.0, float("nan")],), ([float("inf"), 0.0],), ([1.0],), (None,), ([1.0, None],), ([1.0, 2.0],)], "a array<float>")
    assert [r[0] for r in bad.select(v.is_valid(F.col("a"), 2)).collect()] == [False] * 5 + [True]


@pytest.mark.parametrize("space", ["cosine", "l2"])
def test_exact(spark, space):
    x = np.random.default_rng(1).normal(size=(200, DIM)).astype(np.float32).astype(float)
    got = knn.knn(frame(spark, x), asking(spark, x[:7]), 5, space).toPandas()
    for i in range(7):
        d = 1 - x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i]) if space == "cosine" else ((x - x[i]) ** 2).sum(1)
        own = got[got.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == np.argsort(d, kind="stable")[:5].tolist()
        assert own.distance.to_numpy() == pytest.approx(np.sort(d)[:5], abs=1e-6)


def test_ties_sets_and_errors(spark, monkeypatch):
    same = frame(spark, np.ones((20, 3)))
    assert [r["vec_id"] for r in knn.knn(same, asking(spark, np.ones((1, 3))), 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert knn.knn(same, asking(spark, np.ones((2, 3))), 100).count() == 40
    monkeypatch.setattr(knn, "QUERY_NUMBERS", 4)
    assert knn.knn(same, asking(spark, np.ones((5, 3))), 2).count() == 10
    with pytest.raises(ValueError):
        knn.knn(same, asking(spark, np.ones((1, 3))), 0)
    with pytest.raises(ValueError):
        knn.knn(same.limit(0), asking(spark, np.ones((1, 3))), 1)
    with pytest.raises(ValueError):
        knn.knn(same, asking(spark, np.full((1, 3), np.nan)), 1)


@pytest.mark.parametrize(("n", "k"), [(500, 10), (300, 1), (300, 50)])
def test_recall(spark, n, k):
    x, q = unit(123, n), unit(456, 10)
    table, asked = frame(spark, x), asking(spark, q)
    config = IndexConfig(dim=DIM, ef_search=100)
    found = ann.search(ann.build(table, config, shard=200), asked, k, config).withColumnRenamed("id", "vec_id")
    recall = knn.recall_at_k(found, knn.knn(table, asked, k), k).agg(F.avg("recall")).first()[0]
    assert recall > 0.9


def test_graph_properties(spark):
    config = IndexConfig(dim=DIM, ef_construction=40)
    x = unit(42, 60)
    graph = ann.build(frame(spark, x, 1000), config).persist()
    top = ann.search(graph, asking(spark, x[:5]), 1, config).collect()
    assert {(r["query_id"], r["id"]) for r in top} == {(i, 1000 + i) for i in range(5)} and all(r["distance"] < 0.01 for r in top)
    assert graph.collect() == ann.build(frame(spark, x, 1000), config).collect()
    s = ann.stats(graph).first()
    assert (s["size"], s["dim"]) == (60, DIM) and s["total_edges"] > 0
    assert max(len(layer) for r in graph.collect() for i, layer in enumerate(r["neighbours"]) if i == 0) <= config.m0
    more = ann.insert(graph, frame(spark, unit(9, 5), 2000), config)
    assert ann.search(more, asking(spark, unit(9, 5)), 1, config).where("id >= 2000").count() == 5
    assert ann.stats(ann.compacted(more, config)).first()["size"] == 65
    assert ann.search(graph, asking(spark, x[:1]), 100, config).count() == 60


def test_graph_edges(spark):
    config = IndexConfig(dim=3)
    one = ann.build(frame(spark, np.zeros((1, 3))), config)
    assert ann.search(one, asking(spark, np.zeros((1, 3))), 1, config).count() == 1
    same = ann.build(frame(spark, np.ones((20, 3))), config)
    found = ann.search(same, asking(spark, np.ones((1, 3))), 5, config).collect()
    assert len(found) == 5 and all(r["distance"] < 0.01 for r in found)
    l2 = IndexConfig(dim=3, space="l2", normalize=False)
    raw = np.random.default_rng(789).normal(size=(50, 3)) * 9
    top = ann.search(ann.build(frame(spark, raw), l2), asking(spark, raw[:4]), 1, l2).collect()
    assert {(r["query_id"], r["id"]) for r in top} == {(i, i) for i in range(4)}
    for bad in (frame(spark, np.ones((4, 3))).limit(0),):
        with pytest.raises(ValueError):
            ann.build(bad, config)
    for bad in (np.full((2, 3), np.nan), np.full((2, 3), np.inf), np.ones((2, 4))):
        with pytest.raises(Exception, match="finite|components"):
            ann.build(frame(spark, bad), config).count()
    with pytest.raises(ValueError):
        ann.search(same, asking(spark, np.ones((1, 3))), 0, config)
    with pytest.raises(ValueError):
        ann.search(same, asking(spark, np.ones((1, 2))), 1, config)
