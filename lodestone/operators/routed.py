"""Approximate nearest neighbours that read a part of the index: vectors in cells, cells in folders of their own.

A few hundred vectors of the table for each cell, at most, are clustered on the driver; every vector then goes to the cell of its nearest centroid, and
to the second nearest as well if it lies near the border.  A cell is cut into shards of bounded size, each a small-world graph in one row: its vectors, levels
and neighbours as packed arrays.  Rows are stored by cell, so a search reads the folders of those cells alone that its queries are sent to.  The
driver sends them, by products with the centroids.

The index changes in place.  A new vector looks up its neighbours in its cell's graphs and becomes one row of a delta: its
vector, level and links.  A removed one is a row without them.  Whoever walks a shard's graph applies its deltas: back links of new nodes are added and cut
to the most diverse, neighbours of removed ones are linked with what lay behind.  A delta is written in full before the manifest names it; once they
are many, ``compacted`` builds the cells that they touch again.

A walk takes milliseconds whatever the shard's size, so in a shard of at most SCANNED numbers all queries (and all new vectors) meet all its vectors in
one matrix product instead, which is exact and needs no links.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.ann import Graph, chosen, level_of
from lodestone.operators.knn import QUERY_NUMBERS, best, distances, knn, matrix, unit
from lodestone.plans.config import IndexConfig
from lodestone.session import ship
from lodestone.sources.files import deleted, exists, put_small_file, small_file

#: Vectors of a shard at most; of a cell, about; cells at least (of SMALL vectors at least) and at most.
SHARD, CELL, SMALL, FEWEST, MOST = 4096, 4096, 128, 64, 16_384
#: Vectors of the sample for each cell, and numbers in the sample at most.
EACH, SAMPLE_NUMBERS = 64, 1 << 26
#: A vector goes to a second cell if that centroid is farther by no more than this part.
BORDER = 0.1
#: Cells that a query is sent to are so many that of the neighbours of a few vectors of the table this part is in them.
ASKED, NEIGHBOURS, ENOUGH = 64, 10, 0.98
#: Numbers in a shard up to which a product is faster than walks; numbers in a block of distances; pairs of a query and a cell in one set of queries.
SCANNED, BLOCK, PAIRS = 1 << 22, 1 << 21, 1 << 24
#: What rounding may add to a distance, as a part of the length of the vectors.
MARGIN = 1e-6
ROUNDS = 12
#: An index is built anew once it has so many times the vectors that it was built for.
GROWN = 4
MANIFEST, MAGIC = "routed.json", "LODE-ROUTED"

NOTHING = dict.fromkeys(["ids", "levels", "vectors", "sizes", "targets"])
PACKED = "shard int, n int, ids binary, levels binary, vectors binary, sizes binary, targets binary"
DELTA = "id long, level int, vector array<float>, neighbours array<array<long>>, gone boolean"


class Links:
    """The neighbours of each node by layer, unpacked when they are asked for."""

    def __init__(self, levels: np.ndarray, sizes: np.ndarray, targets: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(levels + 1)])
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.targets = targets
        self.known: dict[int, list[list[int]]] = {}
        self.n = len(levels)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, node: int) -> list[list[int]]:
        if node not in self.known:
            a, b = self.first[node], self.first[node + 1]
            self.known[node] = [self.targets[self.start[i] : self.start[i + 1]].tolist() for i in range(a, b)]
        return self.known[node]

    def append(self, layers: list[list[int]]) -> None:
        self.known[self.n] = layers
        self.n += 1


class Shard(Graph):
    """A stored graph; ``ids`` by node.  Removed nodes keep their place without links to or from them."""

    def __init__(self, config: IndexConfig, ids: np.ndarray, levels: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, targets: np.ndarray):
        super().__init__(config, vectors)
        self.ids, self.raw = ids.tolist(), vectors
        self.place = {i: n for n, i in enumerate(self.ids)}
        self.links = Links(levels, sizes, targets)
        self.levels = levels.tolist()
        self.entry = int(levels.argmax()) if len(levels) else -1
        self.dead: set[int] = set()

    @classmethod
    def built_of(cls, config: IndexConfig, ids: list[int], vectors: np.ndarray) -> dict:
        """A packed row of vectors in the order of their ids."""
        graph = Graph(config, vectors).built([level_of(i, config.m, config.seed) for i in ids])
        return cls.row(ids, vectors, graph.links)

    @staticmethod
    def row(ids: list[int], vectors: np.ndarray, links) -> dict:
        layers = [links[n] for n in range(len(ids))]
        return {
            "n": len(ids), "ids": np.array(ids, "<i8").tobytes(), "levels": np.array([len(x) - 1 for x in layers], "<i4").tobytes(), "vectors": vectors.astype("<f4").tobytes(),
            "sizes": np.array([len(own) for x in layers for own in x], "<i4").tobytes(), "targets": np.array([n for x in layers for own in x for n in own], "<i4").tobytes(),
        }

    @classmethod
    def loaded(cls, config: IndexConfig, row: dict) -> Shard:
        number = lambda name, kind: np.frombuffer(row[name] or b"", kind)
        return cls(config, number("ids", "<i8"), number("levels", "<i4"), number("vectors", "<f4").reshape(-1, config.dim).astype(np.float64), number("sizes", "<i4"), number("targets", "<i4"))

    def nearest_of(self, node: int, candidates: list[int], most: int) -> list[int]:
        """Of some nodes the most diverse near one."""
        candidates = sorted({c for c in candidates if c != node and c not in self.dead})
        if not candidates:
            return []
        far = self.far(self.x[node], candidates)
        order = np.lexsort((candidates, far))[: self.config.ef_construction]
        near = [candidates[i] for i in order.tolist()]
        between = self.between(near)
        return [near[i] for i in chosen(between, np.arange(len(near)), far[order], most)]

    def between(self, nodes: list[int] | np.ndarray) -> np.ndarray:
        """Distances among some nodes."""
        x = self.x[nodes]
        if not (self.cosine and self.config.normalize):
            return distances(x, x, "cosine" if self.cosine else "l2")
        d, none = 1 - x @ x.T, self.square[nodes] < 0.5
        d[none] = d[:, none] = 1.0
        return d

    def most(self, layer: int) -> int:
        return self.config.m if layer else self.config.m0

    def candidates(self, vector: np.ndarray, level: int) -> list[list[int]]:
        """By layer, from the lowest: the diverse ones of the ``ef_construction`` nearest that a search finds; as nodes."""
        if self.entry < 0:
            return [[] for _ in range(level + 1)]
        q = unit(vector[None])[0] if self.cosine and self.config.normalize else vector
        top = self.levels[self.entry]
        near = [(float(self.far(q, [self.entry])[0]), self.entry)]
        found: list[list[int]] = [[] for _ in range(level + 1)]
        for layer in range(top, -1, -1):
            if layer > level:
                near = self.beam(q, near[:1], layer, 1)
                continue
            near = self.beam(q, near, layer, self.config.ef_construction)
            nodes, far = [n for _, n in near], np.array([d for d, _ in near])
            found[layer] = [nodes[i] for i in chosen(self.between(nodes), np.arange(len(nodes)), far, self.config.m)]
        return found

    def joined(self, first: int) -> list[list[list[int]]]:
        """What ``candidates`` gives for each node from ``first`` on, among all before it and by products: for shards of few numbers.  Links aren't looked at."""
        levels, most = np.array(self.levels), self.config.ef_construction
        found = []
        for at in range(first, len(levels), 256):
            for node, far in enumerate(self.far_from(at, 256), at):
                layers = []
                for layer in range(levels[node] + 1):
                    nodes = np.flatnonzero(levels[:node] >= layer)
                    own = far[nodes]
                    if len(nodes) > most:
                        near = np.argpartition(own, most)[:most]
                        nodes, own = nodes[near], own[near]
                    order = np.lexsort((nodes, own))
                    nodes = nodes[order]
                    layers.append([int(nodes[i]) for i in chosen(self.between(nodes), np.arange(len(nodes)), own[order], self.config.m)] if len(nodes) else [])
                found.append(layers)
        return found

    def add(self, id_: int, vector: np.ndarray, neighbours: list[list[int]]) -> None:
        """A new node with its links (ids), and links back from these, cut to the most diverse where they are too many."""
        node = len(self.links)
        if node == len(self.raw):  # room for some more
            more = max(64, node // 4)
            self.raw, self.x = (np.concatenate([x, np.zeros((more, self.config.dim))]) for x in (self.raw, self.x))
            self.square = np.concatenate([self.square, np.zeros(more)])
        own = unit(vector[None])[0] if self.cosine and self.config.normalize else vector
        self.raw[node], self.x[node], self.square[node] = vector, own, (own * own).sum()
        layers = [[n for i in x if (n := self.place.get(i)) is not None and n not in self.dead and self.levels[n] >= layer] for layer, x in enumerate(neighbours)]
        self.ids.append(id_)
        self.place[id_] = node
        self.levels.append(len(layers) - 1)
        self.links.append(layers)
        for layer, near in enumerate(layers):
            for other in near:
                back = self.links[other][layer]
                back.append(node)
                if len(back) > self.most(layer):
                    self.links[other][layer] = self.nearest_of(other, back, self.most(layer))
        if self.entry < 0 or self.levels[node] > self.levels[self.entry]:
            self.entry = node

    def remove(self, ids: set[int]) -> None:
        """Takes nodes out; those that linked to one are linked with its other neighbours instead."""
        gone = {self.place.pop(i) for i in ids & self.place.keys()}
        if not gone:
            return
        self.dead |= gone
        for node in range(len(self.links)):
            if node in self.dead:
                continue
            for layer, near in enumerate(self.links[node]):
                lost = [n for n in near if n in gone]
                if lost:
                    behind, seen = [], set(lost)
                    while lost:  # over several removed ones in a row
                        for n in self.links[lost.pop()][layer]:
                            if n in gone and n not in seen:
                                seen.add(n)
                                lost.append(n)
                            elif n not in gone:
                                behind.append(n)
                    self.links[node][layer] = self.nearest_of(node, [n for n in near if n not in gone] + behind, self.most(layer))
        alive = [n for n in range(len(self.links)) if n not in self.dead]
        self.entry = max(alive, key=lambda n: (self.levels[n], -n), default=-1)

    def applied(self, deltas: pd.DataFrame) -> Shard:
        """``deltas``: rows of this shard, in any order.  Updates count in their order; in one, what goes does so before what comes."""
        for _, own in deltas.sort_values(["change", "id"], kind="stable").groupby("change"):
            self.remove(set(own.loc[own["gone"], "id"].tolist()))
            for r in own[~own["gone"]].itertuples():
                if r.id not in self.place:
                    self.add(r.id, np.array(r.vector, np.float64), [list(x) for x in r.neighbours])
        return self

    def alive(self) -> tuple[list[int], np.ndarray]:
        nodes = sorted(self.place.values(), key=lambda n: self.ids[n])
        return [self.ids[n] for n in nodes], self.raw[nodes]


def present(config: IndexConfig, row: dict, deltas: pd.DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, levels, vectors of a stored shard after its deltas: what ``applied`` leaves, without links."""
    shard = Shard.loaded(config, row)
    ids, levels, x = np.array(shard.ids, np.int64), np.array(shard.levels, np.int64), shard.raw
    for _, own in () if deltas is None else deltas.groupby("change"):
        stay = ~np.isin(ids, own.loc[own["gone"], "id"].to_numpy(np.int64))
        fresh = own[~own["gone"]].drop_duplicates("id")
        fresh = fresh[~fresh["id"].isin(ids[stay])].sort_values("id")
        ids, levels = np.concatenate([ids[stay], fresh["id"].to_numpy(np.int64)]), np.concatenate([levels[stay], [len(x) - 1 for x in fresh["neighbours"]]]).astype(np.int64)
        x = np.concatenate([x[stay], np.array(fresh["vector"].tolist(), np.float64).reshape(-1, config.dim)])
    return ids, levels, x


def scanned(config: IndexConfig, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place of the query, id, distance of the k nearest to each of ``own``, ties to smaller ids."""
    if not len(ids) or not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if config.space == "l2":  # nearer to zero there is less rounding
        x, own = x - (middle := x.mean(0)), own - middle
    step, parts = max(1, BLOCK // len(ids)), []
    for at in range(0, len(own), step):
        d = distances(own[at : at + step], x, config.space)
        pick = best(d, ids, k)
        parts.append((np.repeat(np.arange(at, at + len(d)), pick.shape[1]), ids[pick].ravel(), np.take_along_axis(d, pick, 1).ravel()))
    places, found, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    return places, found, far


@dataclass
class Router:
    """Centroids, and where they stand."""

    config: IndexConfig
    centroids: np.ndarray
    x: np.ndarray = field(init=False)

    def __post_init__(self):
        self.x = self.placed(self.centroids)

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Where vectors stand among the cells: on the unit sphere for cosine."""
        return unit(vectors) if self.config.space == "cosine" else vectors

    def all_by_distance(self, vectors: np.ndarray) -> np.ndarray:
        x, c = self.placed(vectors), self.x
        return ((c * c).sum(1) - 2 * x @ c.T).argsort(1, kind="stable")


def balanced(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centroids of about equal cells: rounds of k-means, in each of which the smallest cells are given up and the largest split instead."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for i in range(ROUNDS):
        near = np.concatenate([((centres * centres).sum(1) - 2 * x[at : at + 4096] @ centres.T).argmin(1) for at in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        filled = size > 0
        centres[filled] = total[filled] / size[filled, None]
        if i < ROUNDS - 2:
            order = np.argsort(size, kind="stable")
            small, large = order[: cells // 4], order[::-1][: cells // 4]
            for a, b in zip(small.tolist(), large.tolist(), strict=True):
                own = x[near == b]
                if size[b] > 2 * max(1, len(x) // cells) and size[a] < len(x) / cells / 2 and (own != own[0]).any():
                    centres[a], centres[b] = own[rng.integers(len(own))], own[rng.integers(len(own))]
    return np.unique(centres, axis=0)


def cells_for(n: int, cell: int = CELL) -> int:
    return int(max(1, min(MOST, max(-(-n // cell), min(FEWEST, n // SMALL)))))


def checked(rows: DataFrame, config: IndexConfig, id_col: str, vector: str) -> DataFrame:
    """id, vector."""
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("vector"))


def dealt(rows: DataFrame, router: Router) -> DataFrame:
    """cell, id, vector, and home: a row for the nearest cell (home) and one for the second nearest if the vector lies near the border."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast((router.config, router.centroids))  # at most MOST centroids
    dim = router.config.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config, centroids = shipped.value
        c = unit(centroids) if config.space == "cosine" else centroids
        square = (c * c).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), dim)
            if not np.isfinite(x).all():
                raise ValueError("a vector is not finite")
            x = unit(x) if config.space == "cosine" else x
            for at in range(0, len(x), 1024):
                part = x[at : at + 1024]
                d = np.sqrt(np.maximum((part * part).sum(1)[:, None] + square - 2 * part @ c.T, 0))
                first = d.argmin(1)
                rows_ = np.arange(len(part))
                near = d[rows_, first]
                d[rows_, first] = np.inf
                second = d.argmin(1)
                both = (d[rows_, second] <= (1 + BORDER) * near) & (len(c) > 1)
                place = np.concatenate([rows_, rows_[both]]) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([first, second[both]]).astype(np.int32)), b.column(0).take(pa.array(place)), b.column(1).take(pa.array(place)), pa.array(np.arange(len(place)) < len(part))], ["cell", "id", "vector", "home"]
                )

    return rows.select("id", "vector").mapInArrow(run, "cell int, id long, vector array<float>, home boolean")


def packed(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """cell and a packed graph for each (cell, shard) of rows with id and vector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id", kind="stable")
        row = Shard.built_of(config, pdf["id"].tolist(), np.array(pdf["vector"].tolist(), np.float64).reshape(len(pdf), -1))
        return pd.DataFrame([{"cell": pdf["cell"].iloc[0], "shard": pdf["shard"].iloc[0]} | row])

    return rows.select("cell", "shard", "id", "vector").groupBy("cell", "shard").applyInPandas(run, f"cell int, {PACKED}")


def sharded(rows: DataFrame, shard: int) -> DataFrame:
    """Adds the shard within the cell: as many as the cell's rows need, by a hash of the id.  ``rows`` is a written table."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("shards"))
    # a row for each of MOST cells at most
    return rows.join(F.broadcast(counts), "cell").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards")


@dataclass
class Index:
    """A stored index as the manifest names it."""

    spark: SparkSession
    folder: str
    entry: dict
    config: IndexConfig
    router: Router

    def shards(self) -> DataFrame:
        return self.spark.read.schema(f"{PACKED}, cell int").parquet(*[f"{self.folder}/{b}" for b in self.entry["base"]])

    def deltas(self) -> DataFrame | None:
        """change (its number), cell, shard and DELTA, of updates that are not compacted yet."""
        found = None
        for change, name in self.entry["deltas"]:
            one = self.spark.read.schema(f"shard int, {DELTA}, cell int").parquet(f"{self.folder}/{name}").withColumn("change", F.lit(change))
            found = one if found is None else found.unionByName(one)
        return found

    def ids(self) -> DataFrame:
        """id of each vector that the index has, once."""
        known = self.places().select("id", F.lit(0).alias("change"), F.lit(True).alias("there"))
        if (deltas := self.deltas()) is not None:
            known = known.unionByName(deltas.select("id", "change", (~F.col("gone")).alias("there")))
        # of a vector's changes the last counts; in one change what comes counts, not what goes
        return known.groupBy("id").agg(F.max(F.struct("change", "there")).alias("last")).where("last.there").select("id")

    def places(self) -> DataFrame:
        """id, cell, shard of all vectors in the base."""
        return self.spark.read.schema("id long, cell int, shard int").parquet(*[f"{self.folder}/{b}" for b in self.entry["places"]])


def settings(spark: SparkSession) -> None:
    """A batch for Python holds a few shards at most."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def saved(folder: str, entry: dict) -> None:
    put_small_file(f"{folder}/{MANIFEST}", json.dumps(entry, indent=2).encode())


def load(spark: SparkSession, folder: str) -> Index:
    settings(spark)
    entry = json.loads(small_file(f"{folder}/{MANIFEST}"))
    if entry.get("magic") != MAGIC:
        raise ValueError(f"{folder} is not a routed index")
    return Index(spark, folder, entry, IndexConfig(**entry["config"]), router_of(spark, folder, entry))


def router_of(spark: SparkSession, folder: str, entry: dict) -> Router:
    rows = spark.read.schema("cell int, centroid array<double>").parquet(f"{folder}/{entry['centroids']}").orderBy("cell").collect()  # at most MOST
    return Router(IndexConfig(**entry["config"]), np.array([r[1] for r in rows]))


def build(vectors: DataFrame, folder: str, config: IndexConfig, id_col: str = "vec_id", vector: str = "embedding", cell: int = CELL, shard: int = SHARD) -> Index:
    """Writes the index of all vectors and gives it.  Of rows with one id one counts.

    The centroids come from a bounded sample, those with the smallest hashes of their ids; every vector is indexed.  Errors: no rows, other lengths than ``config.dim``, NaN or infinite parts.
    """
    spark = vectors.sparkSession
    settings(spark)
    rows = checked(vectors, config, id_col, vector)
    n = rows.count()
    if not n:
        raise ValueError("an index needs at least one vector")
    cells = cells_for(n, cell)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(int(max(cells, min(EACH * cells, SAMPLE_NUMBERS // config.dim)))).select("vector").toArrow()
    x = matrix(sample.column(0).combine_chunks(), config.dim)
    if not np.isfinite(x).all():
        raise ValueError("a vector is not finite")
    x = np.unique(unit(x) if config.space == "cosine" else x, axis=0)
    router = Router(config, balanced(x, min(cells, len(x)), config.seed))
    name = f"b-{uuid.uuid4().hex}"
    spark.createDataFrame([(i, c) for i, c in enumerate(router.centroids.tolist())], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/{name}/centroids")
    dealt(rows, router).write.parquet(f"{folder}/{name}/dealt")
    placed = sharded(spark.read.parquet(f"{folder}/{name}/dealt"), shard)
    placed.select("id", "cell", "shard").write.parquet(f"{folder}/{name}/places")
    packed(placed, config).write.partitionBy("cell").parquet(f"{folder}/{name}/shards")
    probes = probes_for(rows, placed, router)
    entry = {
        "magic": MAGIC, "config": config.fields(), "rows": n, "built": n, "cells": len(router.centroids), "shard": shard, "probes": probes, "changes": 0,
        "base": [f"{name}/shards"], "places": [f"{name}/places"], "centroids": f"{name}/centroids", "deltas": [], "changed": 0,
    }
    saved(folder, entry)
    deleted(spark, f"{folder}/{name}/dealt")
    return Index(spark, folder, entry, config, router)


def probes_for(rows: DataFrame, placed: DataFrame, router: Router) -> int:
    """How many cells hold ENOUGH of the true neighbours of ASKED vectors of the table, by an exact search for these."""
    asked = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(ASKED).select(F.col("id").alias("query_id"), F.col("vector").alias("query")).toPandas()
    queries = rows.sparkSession.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(asked["query_id"], asked["query"], strict=True)], "query_id long, query array<float>")
    truth = knn(rows, queries, NEIGHBOURS + 1, router.config.space, "id", "vector").where("id <> query_id").select("query_id", "id")
    order = router.all_by_distance(np.array(asked["query"].tolist(), np.float64))
    rank = {int(i): np.argsort(o).tolist() for i, o in zip(asked["query_id"], order, strict=True)}
    # at most ASKED x NEIGHBOURS rows, each with two cells at most
    found = placed.select("id", "cell").join(F.broadcast(truth), "id").groupBy("query_id", "id").agg(F.collect_set("cell").alias("cells")).collect()
    needed = sorted(min(rank[r["query_id"]][c] for c in r["cells"]) + 1 for r in found)
    return needed[min(len(needed) - 1, int(ENOUGH * len(needed)))] if needed else 1


def routed(index: Index, asked: np.ndarray, probes: int, within: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """cell -> places of the queries that go there: those that it is one of the ``probes`` nearest cells of.

    ``within``, by query: a cell that can hold no vector at this distance or nearer is left out.  Of the vectors whose home a cell is none is nearer to another centroid, so
    they all lie beyond the plane half-way between the cell's centroid and the query's nearest one.
    """
    router, to = index.router, {}
    q, c = router.placed(asked), router.x
    square, cells = (c * c).sum(1), np.arange(len(c))
    for at in range(0, len(q), step := max(1, BLOCK // len(c))):
        part = q[at : at + step]
        d = square - 2 * part @ c.T  # squares of the distances, less the same for all cells of a query
        if probes < len(c):
            near = np.argpartition(d, probes - 1, axis=1)[:, :probes]
            sent = np.zeros(d.shape, bool)
            np.put_along_axis(sent, near, True, 1)
        else:
            sent = np.ones(d.shape, bool)
        if within is not None:
            first, far = d.argmin(1), within[at : at + step, None]
            every = np.isinf(far)
            far = np.where(every, 0, far)
            more = MARGIN * (np.sqrt((part * part).sum(1)) + np.sqrt(square.max()))[:, None] + MARGIN * far
            between = np.sqrt(np.maximum(square[first][:, None] + square - 2 * c[first] @ c.T, 0))
            sent &= (d - d.min(1, keepdims=True) <= 2 * (between + more) * (far + more)) | (cells == first[:, None]) | every
        for cell in np.flatnonzero(sent.any(0)).tolist():
            to.setdefault(cell, []).append(np.flatnonzero(sent[:, cell]) + at)
    return {cell: np.concatenate(x) for cell, x in to.items()}


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, ef: int | None = None, sure: bool = False) -> DataFrame:
    """query_id, rank, id, distance.  ``queries``: query_id, query; they come to the driver in sets of bounded size, each reads the cells it needs.

    ``probes``: cells for each query; by default what the index measured.  k above the number of vectors in these cells gives those.
    ``sure``: nothing nearer is missed.  The nearest cell tells how far a query's k-th neighbour is at most, and all cells are read that can hold a nearer vector: on vectors in tight groups these
    are few, on vectors without any structure nearly all.  Errors: k below 1, queries of another length or not finite.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    config, cells = index.config, len(index.router.centroids)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<float>").alias("query"))
    probes, ef = cells if sure else min(cells, probes or index.entry["probes"]), ef or config.ef_search
    most = max(1, min(QUERY_NUMBERS // config.dim, PAIRS // probes))
    first = asked.limit(most + 1).toArrow()
    if len(first) <= most:
        partial = one_set(index, first, k, probes, ef, sure)
    else:
        sets = -(-2 * asked.count() // most)
        parts = [one_set(index, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i).toArrow(), k, probes, ef, sure) for i in range(sets)]
        partial = parts[0]
        for more in parts[1:]:
            partial = partial.unionByName(more)
    return ranked(partial, k)


def ranked(partial: DataFrame, k: int) -> DataFrame:
    # a vector in two cells is found twice; one shuffle by query serves both steps
    once = partial.repartition("query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def one_set(index: Index, rows: pa.Table, k: int, probes: int, ef: int, sure: bool = False) -> DataFrame:
    config = index.config
    ids = rows.column(0).combine_chunks()
    q = matrix(rows.column(1).combine_chunks(), config.dim) if len(rows) else np.zeros((0, config.dim))
    if not np.isfinite(q).all():
        raise ValueError("a query is not finite")
    if not sure:
        return in_cells(index, ids, q, routed(index, q, probes), k, ef)
    few = -(-2 * k * len(index.router.centroids) // max(1, index.entry["rows"]))  # cells that should hold k
    found = ranked(in_cells(index, ids, q, routed(index, q, min(probes, few)), k, ef, sure), k).where(F.col("rank") == k).select("query_id", "distance").toArrow()  # a row for each query at most
    # squares; of unit vectors half the square is what the cosine lacks of 1, and zero vectors are not farther than they count
    far = dict(zip(found.column(0).to_pylist(), np.sqrt(found.column(1).to_numpy() * (2 if config.space == "cosine" else 1)).tolist(), strict=True))
    return in_cells(index, ids, q, routed(index, q, probes, np.array([far.get(i, np.inf) for i in ids.to_pylist()])), k, ef, sure)


def in_cells(index: Index, query_ids: pa.Array, q: np.ndarray, to: dict[int, np.ndarray], k: int, ef: int, sure: bool = False) -> DataFrame:
    """query_id, id, distance: the nearest that each query's cells have, from each shard."""
    config, spark = index.config, index.spark
    shipped = spark.sparkContext.broadcast((query_ids, q, to))
    most = SCANNED
    names = ["query_id", "id", "distance"]

    def found_in(cell: int, row: dict, deltas: pd.DataFrame | None = None) -> pa.RecordBatch:
        asking, own, here = shipped.value
        asking, own = asking.take(pa.array(here[cell])), own[here[cell]]
        vectors = len(row["vectors"] or b"") // 4 + config.dim * (0 if deltas is None else len(deltas))
        if sure or vectors <= most:
            ids, _, x = present(config, row, deltas)
            places, found, far = scanned(config, ids, x, own, k)
            return pa.RecordBatch.from_arrays([asking.take(pa.array(places)), pa.array(found), pa.array(far)], names)
        shard = Shard.loaded(config, row)
        if deltas is not None:
            shard.applied(deltas)
        own = unit(own) if config.space == "cosine" and config.normalize else own
        out = [(i, shard.ids[n], max(d, 0.0)) for i, v in zip(asking.to_pylist(), own, strict=True) for d, n in shard.search(v, k, ef)]
        ids, found, far = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(far, pa.float64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield found_in(row["cell"], row)

    def changed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].to_dict() if len(left) else NOTHING
        return found_in(int((left if len(left) else right)["cell"].iloc[0]), row, right).to_pandas(integer_object_nulls=True)

    schema = "query_id long, id long, distance double"
    shards = index.shards().where(F.col("cell").isin(list(to)))
    deltas = index.deltas()
    if deltas is None:
        return shards.mapInArrow(run, schema)
    deltas = deltas.where(F.col("cell").isin(list(to)))
    return shards.groupBy("cell", "shard").cogroup(deltas.groupBy("cell", "shard")).applyInPandas(changed, schema)


def updated(index: Index, add: DataFrame | None = None, remove: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding", ratio: float = 0.2, save: bool = True) -> Index:
    """The index with some vectors taken out (``remove``: ids) and others put in; a vector put in under an id that is there takes its place.

    Writes one row for each vector and cell that comes or goes.  Once such rows are over ``ratio`` of all, the cells that they touch are built again.  Removed ids that aren't there change nothing.
    Without ``save`` the manifest stays as it is: the caller keeps the result's ``entry``.
    """
    spark, config = index.spark, index.config
    change, name = index.entry["changes"] + 1, f"d-{uuid.uuid4().hex}"
    ids = [x.select(F.col(f"`{id_col}`").cast("long").alias("id")) for x in (remove, add) if x is not None]
    if not ids:
        return index
    known = index.places()
    before = index.deltas()
    if before is not None:
        known = known.unionByName(before.where("NOT gone").select("id", "cell", "shard"))
    lost = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
    gone = known.distinct().join(lost.distinct(), "id", "left_semi")
    rows = gone.select("cell", "shard", "id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("array<array<long>>").alias("neighbours"), F.lit(True).alias("gone"))
    if add is not None:
        fresh = checked(add, config, id_col, vector).dropDuplicates(["id"])
        fresh.write.parquet(f"{index.folder}/{name}/fresh")
        rows = rows.unionByName(linked(index, spark.read.parquet(f"{index.folder}/{name}/fresh"), gone))
    rows.write.partitionBy("cell").parquet(f"{index.folder}/{name}/rows")
    written = spark.read.schema(f"shard int, {DELTA}, cell int").parquet(f"{index.folder}/{name}/rows")
    n, came, went = written.agg(F.count("*"), F.countDistinct(F.when(~F.col("gone"), F.col("id"))), F.countDistinct(F.when(F.col("gone"), F.col("id")))).first()
    deleted(spark, f"{index.folder}/{name}/fresh")
    entry = index.entry | {"changes": change, "rows": index.entry["rows"] + came - went, "changed": index.entry["changed"] + n}
    if n:
        entry["deltas"] = [*index.entry["deltas"], (change, f"{name}/rows")]
    after = Index(spark, index.folder, entry, config, index.router)
    if entry["changed"] > ratio * max(1, entry["rows"]):
        return compacted(after, save)
    if save:
        saved(index.folder, entry)
    return after


def linked(index: Index, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Delta rows of new vectors: in each of their cells the shard by their hash, and the neighbours that a search of its graph finds among all that stay, and among those before them in the same delta."""
    config = index.config
    counts = index.shards().groupBy("cell").agg((F.max("shard") + 1).alias("shards"))
    placed = dealt(fresh, index.router).join(F.broadcast(counts), "cell", "left").withColumn("shard", F.pmod(F.xxhash64("id"), F.coalesce("shards", F.lit(1))).cast("int"))
    new = placed.select("cell", "shard", "id", "vector", F.lit(False).alias("gone"), F.lit(0).alias("change"), F.lit(None).cast("array<array<long>>").alias("neighbours"))
    # what a shard has had done to it so far, what goes now, and the new ones, in one group
    left = new.unionByName(gone.select("cell", "shard", "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(True).alias("gone"), F.lit(0).alias("change"), F.lit(None).cast("array<array<long>>").alias("neighbours")))
    if (before := index.deltas()) is not None:
        touched = new.select("cell", "shard").distinct()
        left = left.unionByName(before.join(touched, ["cell", "shard"], "left_semi").select(left.columns))

    most = SCANNED

    def run(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        names = ["cell", "shard", "id", "level", "vector", "neighbours", "gone"]
        own = rows[(rows["change"] == 0) & ~rows["gone"]].sort_values("id")
        if not len(own):
            return pd.DataFrame(columns=names, dtype=object)
        row, before, gone = stored.iloc[0].to_dict() if len(stored) else NOTHING, rows[rows["change"] > 0], set(rows.loc[(rows["change"] == 0) & rows["gone"], "id"].tolist())
        if len(row["vectors"] or b"") // 4 + config.dim * len(rows) <= most:
            ids, levels, x = present(config, row, before)
            stay = ~np.isin(ids, list(gone))
            ids = np.concatenate([ids[stay], own["id"].to_numpy(np.int64)])
            levels = np.concatenate([levels[stay], [level_of(i, config.m, config.seed) for i in own["id"].tolist()]])
            shard = Shard(config, ids, levels, np.concatenate([x[stay], np.array(own["vector"].tolist(), np.float64)]), np.zeros(0, int), np.zeros(0, int))
            near = shard.joined(first := int(stay.sum()))
            return pd.DataFrame([(r.cell, r.shard, r.id, shard.levels[n], r.vector, [[shard.ids[i] for i in layer] for layer in near[n - first]], False) for n, r in enumerate(own.itertuples(), first)], columns=names)
        shard = Shard.loaded(config, row)
        shard.applied(before)
        shard.remove(gone)
        out = []
        for r in own.itertuples():
            x = np.array(r.vector, np.float64)
            level = level_of(r.id, config.m, config.seed)
            near = [[shard.ids[n] for n in layer] for layer in shard.candidates(x, level)]
            shard.add(r.id, x, near)
            out.append((r.cell, r.shard, r.id, level, r.vector, near, False))
        return pd.DataFrame(out, columns=names)

    cells = [r[0] for r in new.select("cell").distinct().collect()]  # at most MOST
    stored = index.shards().where(F.col("cell").isin(cells))
    return left.groupBy("cell", "shard").cogroup(stored.groupBy("cell", "shard")).applyInPandas(run, f"cell int, shard int, {DELTA}").select("cell", "shard", "id", "level", "vector", "neighbours", "gone")


def compacted(index: Index, save: bool = True) -> Index:
    """The index without deltas: cells that they touch are built again from the vectors they have now, all others keep their files.

    Old files stay, so readers of the version before aren't disturbed.
    """
    deltas, spark, config = index.deltas(), index.spark, index.config
    if deltas is None:
        return index
    name = f"b-{uuid.uuid4().hex}"
    cells = [r[0] for r in deltas.select("cell").distinct().collect()]  # at most MOST
    stored = index.shards().where(F.col("cell").isin(cells))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.loaded(config, left.iloc[0].to_dict() if len(left) else {}.fromkeys(["ids", "levels", "vectors", "sizes", "targets"]))
        ids, x = shard.applied(right).alive()
        cell = int((left if len(left) else right)["cell"].iloc[0])
        return pd.DataFrame({"cell": [cell] * len(ids), "id": ids, "vector": x.astype(np.float32).tolist()})

    rows = stored.groupBy("cell", "shard").cogroup(deltas.groupBy("cell", "shard")).applyInPandas(run, "cell int, id long, vector array<float>")
    rows.write.parquet(f"{index.folder}/{name}/dealt")
    placed = sharded(spark.read.schema("cell int, id long, vector array<float>").parquet(f"{index.folder}/{name}/dealt"), index.entry["shard"])
    kept = index.shards().where(~F.col("cell").isin(cells))
    packed(placed, config).unionByName(kept.select("cell", *[x.split()[0] for x in PACKED.split(", ")])).write.partitionBy("cell").parquet(f"{index.folder}/{name}/shards")
    index.places().where(~F.col("cell").isin(cells)).unionByName(placed.select("id", "cell", "shard")).write.parquet(f"{index.folder}/{name}/places")
    deleted(spark, f"{index.folder}/{name}/dealt")
    entry = index.entry | {"base": [f"{name}/shards"], "places": [f"{name}/places"], "deltas": [], "changed": 0}
    if save:
        saved(index.folder, entry)
    return Index(spark, index.folder, entry, config, index.router)


def outgrown(entry: dict) -> bool:
    """Whether an index has so many more vectors than it was built for that it should have more cells."""
    return entry["rows"] > GROWN * entry["built"] and cells_for(entry["rows"]) > 2 * entry["cells"]


def stats(index: Index) -> dict:
    """rows, cells, shards, probes, changes, delta rows, files of the base."""
    return {x: index.entry[x] for x in ("rows", "cells", "probes", "changes", "changed")} | {"shards": index.shards().count(), "files": len(index.shards().inputFiles())}


def stored(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/{MANIFEST}")
