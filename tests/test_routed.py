"""Routed index: cells, pruned reading, changes in place."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import knn, routed
from lodestone.operators.ann import Graph, level_of
from lodestone.plans.config import IndexConfig

DIM = 48


def clustered(seed, n, dim=DIM, middles=40, spread=0.6):
    r = np.random.default_rng(seed)
    return (r.normal(size=(middles, dim))[r.integers(middles, size=n)] + spread * r.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def asking(rows, every):
    return rows.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def recall(found, rows, queries, k, space="cosine"):
    return knn.recall_at_k(found.withColumnRenamed("id", "vec_id"), knn.knn(rows, queries, k, space), k).agg(F.avg("recall")).first()[0]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = frame(spark, clustered(1, 4000)).cache()
    return rows, routed.build(rows, str(tmp_path_factory.mktemp("routed")), IndexConfig(dim=DIM, ef_construction=60, ef_search=60))


def test_search_reads_few_cells(spark, built):
    rows, index = built
    queries = asking(rows, 100)
    assert recall(routed.search(index, queries, 10), rows, queries, 10) >= 0.95
    one = asking(rows, 4000)
    q = np.array(one.toPandas()["query"].tolist(), np.float64)
    cells = list(routed.routed(index, q, index.entry["probes"]))
    part = index.shards().where(F.col("cell").isin(cells))
    files = part.select("_metadata.file_path").distinct().count()
    assert files <= routed.stats(index)["files"] / 4
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    found = routed.search(index, one, 10)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", text) and text.count("Exchange") == 1  # by query, after the search


def test_build_repeats_and_loads(spark, built, tmp_path):
    rows, index = built
    again = routed.build(rows.repartition(3), str(tmp_path / "again"), index.config)
    assert again.entry["probes"] == index.entry["probes"] and (again.router.centroids == index.router.centroids).all()
    key = lambda i: sorted((r["cell"], r["shard"], bytes(r["ids"]), bytes(r["targets"])) for r in i.shards().collect())
    assert key(again) == key(index)
    queries = asking(rows, 500)
    assert sorted(map(tuple, routed.search(routed.load(spark, index.folder), queries, 3).collect())) == sorted(map(tuple, routed.search(index, queries, 3).collect()))
    homes = [i for r in index.shards().collect() for i in np.frombuffer(r["ids"], "<i8").tolist()]
    assert set(homes) == set(range(4000)) and len(homes) <= 8000


def test_changes_in_place(spark, built, tmp_path):
    rows, _ = built
    index = routed.build(rows, str(tmp_path / "ix"), IndexConfig(dim=DIM, ef_construction=60, ef_search=60))
    before = {r["file_path"] for r in index.shards().select("_metadata.file_path").distinct().collect()}
    new = frame(spark, clustered(2, 400, middles=40), 10_000)
    gone = rows.where("vec_id % 10 = 7").select("vec_id")
    after = routed.updated(index, new, gone, ratio=0.5)
    now = rows.where("vec_id % 10 <> 7").unionByName(new).cache()
    assert after.entry["rows"] == now.count() == 4000
    # the base is as it was; what changed is a row for each vector and cell
    assert {r["file_path"] for r in after.shards().select("_metadata.file_path").distinct().collect()} == before
    assert after.deltas().count() == after.entry["changed"] <= 2 * 800
    queries = asking(now, 40)
    found = routed.search(after, queries, 10, probes=after.entry["probes"] + 4).cache()
    assert recall(found, now, queries, 10) >= 0.95 and found.join(gone, F.col("id") == F.col("vec_id")).isEmpty()
    # the version before is still there
    old = routed.search(index, asking(rows, 1000), 1).collect()
    assert {(r["query_id"], r["id"]) for r in old} == {(i, i) for i in range(0, 4000, 1000)}
    # a second change on top: a vector moves, one that came goes again, an unknown id changes nothing
    moved = frame(spark, clustered(5, 1) + 9, 10_001)
    twice = routed.updated(routed.load(spark, index.folder), moved, spark.createDataFrame([(10_002,), (77_777,)], "vec_id long"), ratio=0.5)
    assert twice.entry["rows"] == 3999 and len(twice.entry["deltas"]) == 2
    top = routed.search(twice, moved.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 1).first()
    assert top["id"] == 10_001 and abs(top["distance"]) < 1e-6
    whole = routed.compacted(twice)
    now = now.where("vec_id NOT IN (10001, 10002)").unionByName(moved).cache()
    assert whole.deltas() is None and recall(routed.search(whole, queries, 10, probes=whole.entry["probes"] + 4), now, queries, 10) >= 0.95
    ids = {i for r in whole.shards().collect() for i in np.frombuffer(r["ids"], "<i8").tolist()}
    assert ids == {r[0] for r in now.select("vec_id").collect()} == {r[0] for r in whole.places().select("id").collect()}
    # many changes build their cells again at once
    assert routed.updated(whole, frame(spark, clustered(3, 50), 20_000), ratio=0.001).entry["deltas"] == []


def test_insert_and_remove_in_one_graph():
    config = IndexConfig(dim=16, m=8, ef_construction=60, ef_search=60)
    x = clustered(4, 900, 16, 5).astype(np.float64)
    shard = routed.Shard.loaded(config, routed.Shard.built_of(config, list(range(600)), x[:600]))
    for i in range(600, 900):
        near = [[shard.ids[n] for n in layer] for layer in shard.candidates(x[i], level_of(i, config.m, 0))]
        assert len(near[0]) <= config.m and i not in near[0]
        shard.add(i, x[i], near)
    shard.remove(set(range(0, 300)))
    alive = list(range(300, 900))
    for node in range(len(shard.links)):
        if node not in shard.dead:
            for layer, near in enumerate(shard.links[node]):
                assert len(near) <= shard.most(layer) and not shard.dead & set(near) and all(shard.levels[n] >= layer for n in near)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(300, 900, 6):
        true = set(sorted(alive, key=lambda j: 1 - unit[i] @ unit[j])[:10])
        hits += len(true & {shard.ids[n] for _, n in shard.search(unit[i], 10, 60)})
    assert hits >= 0.95 * 1000
    assert shard.alive()[0] == alive and (shard.alive()[1] == x[300:].astype(np.float32)).mean() > 0.49
    shard.remove(set(alive))
    assert shard.entry == -1 and shard.search(unit[0], 5, 10) == [] and shard.candidates(x[0], 1) == [[], []]


def test_stored_links_are_the_graph():
    config = IndexConfig(dim=16, m=4)
    x = clustered(6, 200, 16).astype(np.float64)
    graph = Graph(config, x).built([level_of(i, 4, 0) for i in range(200)])
    shard = routed.Shard.loaded(config, routed.Shard.built_of(config, list(range(200)), x))
    assert [shard.links[n] for n in range(200)] == graph.links and len(shard.links) == 200


@pytest.mark.parametrize("space", ["cosine", "l2"])
def test_ties_small_tables_and_errors(spark, tmp_path, space):
    config = IndexConfig(dim=3, space=space)
    same = frame(spark, np.ones((300, 3), np.float32))
    index = routed.build(same.unionByName(same.limit(2)), str(tmp_path / "same"), config, shard=100)
    found = routed.search(index, asking(same, 299), 5).collect()
    assert len(found) == 10 and all(abs(r["distance"]) < 1e-9 for r in found) and routed.stats(index)["cells"] == 1 and routed.stats(index)["shards"] > 1
    one = routed.build(frame(spark, np.zeros((1, 3), np.float32)), str(tmp_path / "one"), config)
    assert routed.search(one, asking(same, 299), 9).count() == 2
    gone = routed.updated(one, remove=frame(spark, np.zeros((1, 3)), 0).select("vec_id"), ratio=9)
    assert gone.entry["rows"] == 0 and routed.search(gone, asking(same, 299), 9).isEmpty()
    back = routed.updated(gone, frame(spark, np.ones((2, 3)), 5), ratio=9)
    assert {r["id"] for r in routed.search(back, asking(same, 299), 9).collect()} == {5, 6}
    assert routed.search(index, asking(same, 299).limit(0), 5).isEmpty() and routed.updated(index) is index
    with pytest.raises(ValueError):
        routed.search(index, asking(same, 299), 0)
    for bad in (same.limit(0), frame(spark, np.full((2, 3), np.nan)), frame(spark, np.ones((2, 4)))):
        with pytest.raises(Exception, match="finite|components|at least one"):
            routed.build(bad, str(tmp_path / "bad"), config)
    with pytest.raises(FileNotFoundError):
        routed.load(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("space", ["cosine", "l2"])
def test_sure_search_is_exact(spark, tmp_path, space):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(1500, 24)), clustered(8, 500, 24, 3, 0.01), np.zeros((2, 24))]).astype(np.float32) + (100 if space == "l2" else 0)
    rows = frame(spark, x).cache()
    index = routed.build(rows.where("vec_id % 10 <> 3"), str(tmp_path / "ix"), IndexConfig(dim=24, space=space, ef_construction=40, ef_search=20))
    index = routed.updated(index, rows.where("vec_id % 10 = 3"), rows.where("vec_id % 10 = 7"), ratio=1.0)
    now, queries = rows.where("vec_id % 10 <> 7").cache(), asking(rows, 20)
    far = lambda found: sorted((r["query_id"], r["rank"], round(r["distance"], 6 if space == "cosine" else 2)) for r in found.collect())
    for k in (1, 10, 200):
        assert far(routed.search(index, queries, k, sure=True)) == far(knn.knn(now, queries, k, space))
    # with few vectors in reach a cell or two are read for each
    q = np.array(queries.toPandas()["query"].tolist(), np.float64)
    assert sum(map(len, routed.routed(index, q, 99, np.zeros(len(q))).values())) <= 1.2 * len(q)
    assert sum(map(len, routed.routed(index, q, 99, np.full(len(q), np.inf)).values())) == len(q) * len(index.router.centroids)


def test_each_finds_itself_in_tight_groups(spark, tmp_path):
    rows = frame(spark, clustered(9, 3000, 32, 6, 0.01)).cache()
    index = routed.build(rows.where("vec_id % 10 <> 3"), str(tmp_path / "ix"), IndexConfig(dim=32, ef_construction=60, ef_search=20))
    index = routed.updated(index, rows.where("vec_id % 10 = 3"), rows.where("vec_id % 10 = 7"), ratio=1.0)
    every = asking(rows, 1).where("query_id % 10 <> 7")
    for sure in (False, True):
        found = routed.search(index, every, 1, **{"sure": True} if sure else {}).collect()
        assert len(found) == 2700 and all(r["query_id"] == r["id"] for r in found)


def test_no_query_lacks_two_neighbours(spark, tmp_path):
    """On vectors without any structure the cells that hold 98 % of all neighbours lack several of some queries'."""
    x = np.random.default_rng(10).normal(size=(8000, 32)).astype(np.float32)
    frame(spark, x).write.parquet(str(tmp_path / "embeddings.parquet"))
    good = catalog.QUERIES["routed_recall"](spark, str(tmp_path)).collect()
    assert len(good) == 80 and all(r["good"] for r in good)


def test_large_shards_are_walked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(routed, "SCANNED", 0)
    rows = frame(spark, clustered(1, 1500)).cache()
    index = routed.build(rows.where("vec_id % 10 <> 3"), str(tmp_path / "ix"), IndexConfig(dim=DIM, ef_construction=60, ef_search=60))
    index = routed.updated(index, rows.where("vec_id % 10 = 3"), rows.where("vec_id % 10 = 7"), ratio=1.0)
    now, queries = rows.where("vec_id % 10 <> 7"), asking(rows, 20)
    walked = routed.search(index, queries, 10, probes=8).cache()
    assert recall(walked, now, queries, 10) >= 0.95
    monkeypatch.undo()
    assert routed.search(index, queries, 10, probes=8).join(walked, ["query_id", "id"]).count() >= 0.95 * walked.count()
