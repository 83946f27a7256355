"""Centroid clustering (Lloyd's rounds) in whole numbers, by kd-tree filtering (Kanungo and others, 2002).

Vectors are cut into blocks of bounded size, each within a partition.  A block becomes a kd-tree once: nodes hold how many vectors they have,
their integer sums and their box, leaves a few vectors.  In each round all centroids go down each tree: of those that are candidates for a node, the one
nearest to the box's middle stays, and so do all that it doesn't dominate strictly.  A centroid is dominated if even the box's corner that lies farthest
towards it is nearer to the other one.  A node with one candidate is assigned whole, by its count and sums; leaves compare all vectors with
what candidates are left.  So a round gives, from each task, one count and one vector of sums for each centroid, which add up exactly.

Trees are a table in the shared folder: a lost executor's blocks are read again by another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Vectors of a block, and of a leaf, at most.
BLOCK, LEAF = 8192, 32
#: Numbers below this have squared distances, and sums of them over a block, that a long holds; up to the second, doubles hold them exactly.
LONG, EXACT = 1 << 24, 1 << 18
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(vectors: DataFrame, scale: int = SCALE, dim: int = DIM, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v, the components as whole numbers, of vectors with exactly ``dim`` components, none null or not finite.  Numbers that a long can't hold become the nearest long."""
    x = F.col(f"`{vector}`")
    sound = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def numbers(rows: list[list[int]] | np.ndarray, dim: int) -> np.ndarray:
    """Rows as longs, or as Python's whole numbers where longs can't hold all that is reckoned with them."""
    x = np.asarray(rows, np.int64).reshape(-1, dim)
    return x if not x.size or -LONG < x.min() and x.max() < LONG else x.astype(object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances between rows, exactly."""
    if x.dtype == object or y.dtype == object:
        return ((x.astype(object)[:, None] - y.astype(object)[None]) ** 2).sum(2)
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if most < EXACT:  # then all sums on the way are whole numbers that a double holds
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)


class Tree:
    """A kd-tree over the rows of a block.  ``order`` is the rows' order in it: a node is a stretch of that."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.bounds: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []  # (-1, -1) for leaves
        self.grow(points, 0, len(points))
        self.points = points[self.order]
        self.low = np.array([self.points[a:b].min(0) for a, b in self.bounds])
        self.high = np.array([self.points[a:b].max(0) for a, b in self.bounds])
        self.sums = np.array([self.points[a:b].sum(0) for a, b in self.bounds])

    def grow(self, points: np.ndarray, start: int, end: int) -> int:
        """Cuts at the middle of the widest side; all equal rows are one leaf, however many there are."""
        node = len(self.bounds)
        self.bounds.append((start, end))
        self.children.append((-1, -1))
        own = points[self.order[start:end]]
        wide = own.max(0) - own.min(0)
        if end - start > LEAF and wide.max() > 0:
            values = own[:, int(wide.argmax())]
            self.order[start:end] = self.order[start:end][np.argsort(values, kind="stable")]
            middle = (start + end) // 2
            self.children[node] = (self.grow(points, start, middle), self.grow(points, middle, end))
        return node

    def packed(self) -> dict[str, bytes]:
        return {
            "points": self.points.astype("<i8").tobytes(), "low": self.low.astype("<i8").tobytes(), "high": self.high.astype("<i8").tobytes(),
            "sums": b"".join(int(s).to_bytes(16, "little", signed=True) for s in self.sums.ravel()) if self.sums.dtype == object else self.sums.astype("<i8").tobytes(),
            "bounds": np.array(self.bounds, "<i4").tobytes(), "children": np.array(self.children, "<i4").tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict, dim: int) -> Tree:
        tree = cls.__new__(cls)
        tree.points, tree.low, tree.high = (numbers(np.frombuffer(row[n], "<i8"), dim) for n in ("points", "low", "high"))
        tree.bounds, tree.children = (np.frombuffer(row[n], "<i4").reshape(-1, 2).tolist() for n in ("bounds", "children"))
        wide = len(row["sums"]) == 16 * dim * len(tree.bounds)
        sums = np.array([int.from_bytes(row["sums"][i : i + 16], "little", signed=True) for i in range(0, len(row["sums"]), 16)], object) if wide else np.frombuffer(row["sums"], "<i8")
        tree.sums = sums.reshape(-1, dim)
        return tree

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray | None]]:
        """(node, start, end, centroid, its rows' own centroids): whole nodes have one centroid and None, leaves a centroid for each row."""
        open_ = [(0, np.arange(len(centroids)))]
        while open_:
            node, near = open_.pop()
            if len(near) > 1:
                near = near[undominated(centroids[near], self.low[node], self.high[node])]
            start, end = self.bounds[node]
            if len(near) == 1:
                yield node, start, end, int(near[0]), None
            elif self.children[node][0] < 0:
                # the first of equal distances is the smaller number
                yield node, start, end, -1, near[squared(self.points[start:end], centroids[near]).argmin(1)]
            else:
                open_ += [(child, near) for child in self.children[node]]


def undominated(centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to some point of the box, ties included."""
    nearest = centroids[squared(2 * centroids, (low + high)[None])[:, 0].argmin()]
    corner = np.where(centroids > nearest, high, low)  # of the box, the farthest towards each
    own, other = corner - centroids, corner - nearest
    return (own * own).sum(1) <= (other * other).sum(1)


BLOCKS = "ids binary, nulls binary, points binary, low binary, high binary, sums binary, bounds binary, children binary"


def trees(rows: DataFrame, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """A row for each block of id, v: its tree, and its ids in the tree's order."""

    def pack(ids: list, vectors: list) -> pa.RecordBatch:
        tree = Tree(numbers(vectors, dim))
        ordered = [ids[i] for i in tree.order.tolist()]
        packed = tree.packed() | {"ids": np.array([i or 0 for i in ordered], "<i8").tobytes(), "nulls": bytes(i is None for i in ordered)}
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([packed[n]], pa.binary()) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            vectors += b.column(1).to_pylist()
            while len(ids) >= block:
                yield pack(ids[:block], vectors[:block])
                del ids[:block], vectors[:block]
        if ids:
            yield pack(ids, vectors)

    return rows.select("id", "v").mapInArrow(run, BLOCKS)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray | None:
    """The k vectors with the smallest hashes of their ids, in that order; ties by the vector, null ids last.  Fewer vectors give fewer."""
    key = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), "UTF-8"), 256)
    found = rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r[0] for r in found], np.int64) if found else None


def moved(blocks: DataFrame, centroids: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The centroids after a round: componentwise floor of sum / count; those without vectors stay.  k rows come to the driver."""
    shipped = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers(shipped.value, dim)
        counts, sums = [0] * len(own), np.zeros((len(own), dim), object)
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.unpacked(row, dim)
                for node, start, end, centroid, each in tree.assigned(own):
                    if each is None:
                        counts[centroid] += end - start
                        sums[centroid] += tree.sums[node].astype(object)
                    else:
                        for c in np.unique(each).tolist():
                            at = each == c
                            counts[c] += int(at.sum())
                            sums[c] += tree.points[start:end][at].sum(0).astype(object)
        some = [c for c, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([counts[c] for c in some], pa.int64()), pa.array([list(map(Decimal, map(int, sums[c]))) for c in some], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "sums"]
        )

    parts = blocks.select(*[c for c in blocks.columns if c not in ("ids", "nulls")]).mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    after = centroids.copy()
    for r in total.collect():
        after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return after


def nearest(blocks: DataFrame, centroids: np.ndarray, dim: int = DIM) -> DataFrame:
    """id, cluster and distance (squared) of each vector; a distance that a long can't hold is the largest long."""
    shipped = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = numbers(shipped.value, dim)
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.unpacked(row, dim)
                cluster, far = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), np.int64)
                for _, start, end, centroid, each in tree.assigned(own):
                    cluster[start:end] = centroid if each is None else each
                    apart = tree.points[start:end].astype(own.dtype) - own[cluster[start:end]]
                    far[start:end] = np.minimum((apart * apart).sum(1), MOST).astype(np.int64)
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(far)], ["id", "cluster", "distance"])

    return blocks.mapInArrow(run, "id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each sound vector.

    Vectors that are null, of another length, or hold null or non-finite components have no row.  Repeated rows and ids count each, null ids stay;
    fewer than k vectors give fewer clusters, an empty table no rows.  Other columns are ignored.  All is reckoned in whole numbers of any size; what a long can't hold in the
    result is the nearest long.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole(vectors, scale, dim, id_col, vector)
    centroids = first_centroids(rows, k, seed)
    if centroids is None:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = written(trees(rows, dim, block), "kd-trees")
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dim)
    found = written(nearest(blocks, centroids, dim), "clusters")
    parts = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    every = min(sum(parts.values()), MOST)
    told = [(c, min(n, MOST), every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(parts.items())]
    # a row for each of k clusters at most
    each = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(each, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def sql(k: int = K, rounds: int = ROUNDS) -> str:
    """Each round is a pair of named tables; distances and sums are whole numbers below 2^53, which doubles hold."""
    parts = [
        f"""rows AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v AS w FROM (SELECT * FROM rows ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {k}))""",
    ]
    near = """a{i} AS MATERIALIZED (
  SELECT row, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT row, c, list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w) AS d FROM rows, c{i}) GROUP BY row)"""
    for i in range(rounds):
        parts += [near.format(i=i), f"""m{i} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS w FROM (
    SELECT c, i, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS m FROM (SELECT c, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{i} JOIN rows USING (row)) GROUP BY c, i) GROUP BY c)""",
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} USING (c))"]
    parts.append(near.format(i=rounds))
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(w, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN rows USING (row) JOIN c{rounds} USING (c)"""


SQL = sql()
