"""Approximate nearest neighbours: small-world graphs by shard (Malkov and Yashunin, 2016).

Vectors are dealt to shards by a hash of their id; each shard builds its own layered graph, and a search asks
every shard and merges.  A shard holds few enough vectors that all their distances fit in memory: one matrix product gives them, and
building looks its candidates up there instead of searching for them.  The graph is a table (shard, id, level, neighbours by layer, vector): it is saved, joined
and counted like any other.  Levels come from a hash of the id, so builds repeat exactly.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.knn import QUERY_NUMBERS, distances, unit
from lodestone.plans.config import IndexConfig
from lodestone.session import ship

#: Vectors of a shard at most, about; a smaller table still has so many shards (of SMALL vectors at least), which are built side by side.
SHARD, SHARDS, SMALL = 4096, 8, 256
GRAPH = "shard int, id long, level int, neighbours array<array<long>>, vector array<float>"


def level_of(id_: int, m: int, seed: int) -> int:
    """Geometric levels: floor(-ln(u) / ln(m)), u from a hash of the id."""
    x = (id_ * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * by) & (1 << 64) - 1
    u = max(((x ^ x >> 31) >> 11) / (1 << 53), 1e-9)
    return int(-math.log(u) / math.log(m))


class Graph:
    """One shard's graph; nodes are numbered by insertion."""

    def __init__(self, config: IndexConfig, vectors: np.ndarray):
        self.config = config
        self.cosine = config.space == "cosine"
        self.x = unit(vectors) if self.cosine and config.normalize else vectors
        self.square = (self.x * self.x).sum(1)
        self.links: list[list[list[int]]] = []
        self.entry = -1

    def far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        if self.cosine:
            if self.config.normalize:
                return np.where(self.square[nodes] < 0.5, 1.0, 1 - self.x[nodes] @ q)
            return distances(q[None], self.x[nodes], "cosine")[0]
        d = self.x[nodes] - q
        return (d * d).sum(1)

    def beam(self, q: np.ndarray, entries: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found on a layer, nearest first."""
        seen = {n for _, n in entries}
        open_ = list(entries)
        heapq.heapify(open_)
        found = [(-d, n) for d, n in entries]
        heapq.heapify(found)
        while open_:
            d, node = heapq.heappop(open_)
            if len(found) >= width and d > -found[0][0]:
                break
            new = [n for n in self.links[node][layer] if n not in seen]
            if not new:
                continue
            seen.update(new)
            for e, n in zip(self.far(q, new).tolist(), new, strict=True):
                if len(found) < width:
                    heapq.heappush(found, (-e, n))
                elif e < -found[0][0]:
                    heapq.heapreplace(found, (-e, n))
                else:
                    continue
                heapq.heappush(open_, (e, n))
        return sorted((-d, n) for d, n in found)

    def built(self, levels: list[int]) -> Graph:
        """Inserts all vectors in their order: each is linked to diverse ones of the ``ef_construction`` nearest before it on a layer, and these to it."""
        c = self.config
        d = np.concatenate([self.far_from(at) for at in range(0, len(self.x), 512)])
        on = [np.empty(sum(level >= layer for level in levels), np.int64) for layer in range(max(levels, default=0) + 1)]
        size = [0] * len(on)
        for node, level in enumerate(levels):
            self.links.append([[] for _ in range(level + 1)])
            for layer in range(level, -1, -1):
                before = on[layer][: size[layer]]
                on[layer][size[layer]] = node
                size[layer] += 1
                if not len(before):
                    continue
                far = d[node, before]
                if len(before) > c.ef_construction:
                    near = np.argpartition(far, c.ef_construction)[: c.ef_construction]
                    before, far = before[near], far[near]
                order = np.lexsort((before, far))
                most = c.m if layer else c.m0
                self.links[node][layer] = chosen(d, before[order], far[order], c.m)
                for other in self.links[node][layer]:
                    own = self.links[other][layer]
                    own.append(node)
                    if len(own) > 2 * most:
                        self.trim(d, other, layer, most)
            if self.entry < 0 or level > len(self.links[self.entry]) - 1:
                self.entry = node
        for node, layers in enumerate(self.links):
            for layer, own in enumerate(layers):
                if len(own) > (most := c.m if layer else c.m0):
                    self.trim(d, node, layer, most)
        return self

    def far_from(self, at: int, n: int = 512) -> np.ndarray:
        part = self.x[at : at + n]
        if self.cosine and self.config.normalize:
            d = 1 - part @ self.x.T
            d[self.square[at : at + n] < 0.5] = 1.0
            d[:, self.square < 0.5] = 1.0
            return d.astype(np.float32)
        return distances(part, self.x, "cosine" if self.cosine else "l2").astype(np.float32)

    def trim(self, d: np.ndarray, node: int, layer: int, most: int) -> None:
        own = np.array(self.links[node][layer])
        far = d[node, own]
        order = np.lexsort((own, far))
        self.links[node][layer] = chosen(d, own[order], far[order], most)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        near = [(float(self.far(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.links[self.entry]) - 1, 0, -1):
            near = self.beam(q, near[:1], layer, 1)
        return self.beam(q, near, 0, max(ef, k))[:k]


def chosen(d: np.ndarray, candidates: np.ndarray, far: np.ndarray, m: int) -> list[int]:
    """Of candidates (nearest first) m that are apart from each other: one nearer to a chosen node than to the query waits, and fills up what is left."""
    between = d[candidates[:, None], candidates]
    open_ = np.ones(len(candidates), bool)
    kept: list[int] = []
    while len(kept) < m:
        i = int(open_.argmax())
        if not open_[i]:
            break
        kept.append(i)
        open_[i] = False
        open_ &= between[i] >= far
    if len(kept) < m:
        rest = np.ones(len(candidates), bool)
        rest[kept] = False
        kept += np.flatnonzero(rest)[: m - len(kept)].tolist()
    return candidates[kept].tolist()


def _valid(vectors: np.ndarray, dim: int) -> np.ndarray:
    if vectors.ndim != 2 or vectors.shape[1] != dim:
        raise ValueError(f"vectors must have {dim} components")
    if not np.isfinite(vectors).all():
        raise ValueError("a vector is not finite")
    return vectors.astype(np.float64)


def shards_of(n: int, shard: int) -> int:
    return max(-(-n // shard), min(SHARDS, n // SMALL), 1)


def build(vectors: DataFrame, config: IndexConfig, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, first: int = 0) -> DataFrame:
    """The graph table, lazily: to be written or persisted before it is searched.  Shards are numbered from ``first``.

    Errors: no rows, other lengths than ``config.dim``, NaN or infinite parts.
    """
    ship(vectors.sparkSession)
    n = vectors.count()
    if not n:
        raise ValueError("an index needs at least one vector")
    part = F.pmod(F.xxhash64(id_col), F.lit(shards_of(n, shard))) + first
    return graphs(vectors.select(part.cast("int").alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")), config)


def graphs(rows: DataFrame, config: IndexConfig) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].tolist()
        if any(v is None or len(v) != config.dim for v in pdf["vector"]):
            raise ValueError(f"vectors must have {config.dim} components")
        g = Graph(config, _valid(np.array(pdf["vector"].tolist(), np.float64), config.dim)).built([level_of(i, config.m, config.seed) for i in ids])
        return pd.DataFrame({"shard": pdf["shard"], "id": ids, "level": [len(x) - 1 for x in g.links], "neighbours": [[[ids[n] for n in layer] for layer in x] for x in g.links], "vector": pdf["vector"]})

    return rows.groupBy("shard").applyInPandas(run, GRAPH)


def insert(graph: DataFrame, vectors: DataFrame, config: IndexConfig, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """Appends new vectors as shards of their own, as many as they need; ``compacted`` spreads many small ones evenly again.  Without new vectors nothing changes."""
    if vectors.isEmpty():
        return graph
    last = graph.agg(F.max("shard")).first()[0]
    return graph.unionByName(build(vectors, config, id_col, vector, shard, 0 if last is None else last + 1))


def updated(graph: DataFrame, vectors: DataFrame, config: IndexConfig, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The graph of ``vectors``, from that of an earlier version.  A vector must not change under its id.

    Shards that lost a vector are built again from what they keep, new vectors get shards of their own, all others
    stay as they are.  Where there would be over twice as many shards as are needed, all are built anew.
    """
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    lost = graph.join(ids, "id", "left_anti").select("shard").distinct()
    fresh = vectors.join(graph.select(F.col("id").alias(id_col)), id_col, "left_anti")
    n_new, n, have = fresh.count(), vectors.count(), graph.agg(F.countDistinct("shard")).first()[0]
    if have + (shards_of(n_new, shard) if n_new else 0) > 2 * shards_of(n, shard):
        return build(vectors, config, id_col, vector, shard)
    again = graphs(graph.join(lost, "shard", "left_semi").join(ids, "id", "left_semi").select("shard", "id", "vector"), config)
    return insert(graph.join(lost, "shard", "left_anti").select(*graph.columns).unionByName(again), fresh, config, id_col, vector, shard)


def compacted(graph: DataFrame, config: IndexConfig, shard: int = SHARD) -> DataFrame:
    return build(graph.select("id", "vector"), config, "id", "vector", shard)


def search(graph: DataFrame, queries: DataFrame, k: int, config: IndexConfig, ef: int | None = None) -> DataFrame:
    """query_id, rank, id, distance.  ``queries``: query_id, query; they go to every shard, in sets of bounded size.

    ``graph`` is read once for each set and once more.  k above the number of vectors gives all.  Errors: k below 1, an empty index, bad vectors.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    ship(graph.sparkSession)
    if graph.isEmpty():
        raise ValueError("the index is empty")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
    sets = max(1, -(-asked.count() * config.dim // QUERY_NUMBERS))
    partial = None
    for i in range(sets):
        found = one_set(graph, asked if sets == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i), k, config, ef or config.ef_search)
        partial = found if partial is None else partial.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return partial.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def one_set(graph: DataFrame, queries: DataFrame, k: int, config: IndexConfig, ef: int) -> DataFrame:
    asked = queries.toPandas()
    q = _valid(np.array(asked["query"].tolist(), np.float64).reshape(len(asked), -1) if len(asked) else np.zeros((0, config.dim)), config.dim)
    q = unit(q) if config.space == "cosine" and config.normalize else q
    shipped = graph.sparkSession.sparkContext.broadcast((asked["query_id"].tolist(), q))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        query_ids, own = shipped.value
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy()
        place = {i: n for n, i in enumerate(ids.tolist())}
        g = Graph(config, np.array(pdf["vector"].tolist(), np.float64))
        g.links = [[[place[i] for i in layer] for layer in x] for x in pdf["neighbours"]]
        g.entry = int(np.argmax(pdf["level"].to_numpy()))
        out = [(i, int(ids[n]), max(d, 0.0)) for i, v in zip(query_ids, own, strict=True) for d, n in g.search(v, k, ef)]
        return pd.DataFrame(out, columns=["query_id", "id", "distance"]).astype({"query_id": "int64", "id": "int64", "distance": "float64"})

    return graph.groupBy("shard").applyInPandas(run, "query_id long, id long, distance double")


def stats(graph: DataFrame) -> DataFrame:
    """One row: size, shards, dim, max_level, total_edges."""
    edges = F.aggregate("neighbours", F.lit(0), lambda n, layer: n + F.size(layer))
    return graph.agg(F.count("*").alias("size"), F.countDistinct("shard").alias("shards"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"), F.coalesce(F.max("level"), F.lit(-1)).alias("max_level"), F.coalesce(F.sum(edges), F.lit(0)).alias("total_edges"))
