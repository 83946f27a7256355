"""Exact top-k by inner product as a Voronoi join.

Components become whole numbers, so scores are exact.  A vector x gets one more component that brings all squared
lengths to the same M, a query one that is zero: then |q - x|^2 = |q|^2 + M - 2 q.x, and the highest
scores are the nearest neighbours.  A few pivots part queries and data into cells.  Summaries of the cells (the
smallest and largest distance from the pivot, how many vectors, and the k smallest distances) bound, for all
queries of a cell at once, how far their k-th neighbour can be; a data cell goes to a query cell only
if some of it may be nearer than that.  Query cells that need much the same data are served together.  Each data cell is cut into blocks of bounded size, pairs of
(query block, data block) are solved on their own, and the k best of each query's partial lists remain.

Distances and bounds are doubles, with a margin over all their rounding.  Scores are exact at any size: where a double can't
hold them, the products that may be among the k best are done again in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

SCALE = 1024
K = 10
#: There are sqrt(n) / 8 pivots, at most so many, picked from a sample of so many vectors (or 16 for each pivot).
SAMPLE, PIVOTS = 4096, 1024
#: Vectors in a block of data, and queries in a block, about: each grows with its table up to the second number, which bounds a task's memory.
BLOCK, QUERY_BLOCK = (8192, 32_768), (1024, 16_384)
#: Scores are kept as numbers of so many bits.
BITS = 60


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as whole numbers.

    Null vectors, those with null or non-finite components and null ids go.  Numbers that a long can't hold become the nearest long.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def pivots_of(data: DataFrame, n: int, seed: int = 11) -> np.ndarray:
    """Spread-out vectors of a bounded sample: each is the one farthest from those before it, among a random few."""
    rows = data.orderBy(F.xxhash64("vec_id")).limit(max(SAMPLE, 16 * n)).select("v").toPandas()["v"]
    sample = np.unique(np.array(rows.tolist(), np.float64), axis=0)
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    far = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum())])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(1))
    centres = np.array(chosen)
    for _ in range(6):  # a few rounds of k-means on the sample
        near = (((sample**2).sum(1)[:, None] + (centres**2).sum(1)) - 2 * sample @ centres.T).argmin(1)
        centres = np.array([sample[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return centres


def celled(rows: DataFrame, pivots: np.ndarray, top: float, lift: bool) -> DataFrame:
    """Adds cell and distance from its pivot (pivots have no extra component)."""
    shipped = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shipped.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf["v"].tolist(), np.float64)
            square = (v * v).sum(1)
            d = square[:, None] + (p * p).sum(1) - 2 * v @ p.T
            cell = d.argmin(1)
            near = d[np.arange(len(d)), cell] + (top - square if lift else 0)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "cell": cell.astype(np.int32), "far": np.sqrt(np.maximum(near, 0))})

    return rows.mapInPandas(run, "vec_id long, v array<long>, cell int, far double")


def grouped(needs: dict[int, set[int]], sizes: dict[int, int], most: int = QUERY_BLOCK[0], alike: float = 0.7) -> list[list[int]]:
    """Query cells that need much the same data cells together, up to ``most`` queries: their data is then sent once for all."""
    groups: list[tuple[list[int], set[int], int]] = []
    for i in sorted(needs, key=lambda i: (-len(needs[i]), i)):
        for n, (own, need, size) in enumerate(groups):
            if size + sizes[i] <= most and len(need & needs[i]) >= alike * len(need | needs[i]):
                groups[n] = ([*own, i], need | needs[i], size + sizes[i])
                break
        else:
            groups.append(([i], set(needs[i]), sizes[i]))
    return [own for own, _, _ in groups]


def limbs(score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, middle, low) of whole numbers of any size; they are ordered as the numbers are."""
    mask = (1 << BITS) - 1
    parts = [score >> 2 * BITS, (score >> BITS) & mask, score & mask] if score.dtype == object else [score >> 63, (score >> BITS) & mask, score & mask]
    return tuple(x.astype(np.int64) for x in parts)


def best_of(near: np.ndarray, doubt: np.ndarray | None, q: np.ndarray, ids: np.ndarray, v: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k highest scores of one query (longs) among ``v``, ties to the smaller id, and the scores.  Rows with id ``own`` are left out.

    ``near``: the scores as doubles, ``doubt``: how far each may be from the true one; None if they are exact.
    """
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        sure = near[at] if doubt is None else (near - doubt)[at]
        least = np.partition(sure, -k)[-k]
        at = at[(near[at] if doubt is None else (near + doubt)[at]) >= least]
    score = np.rint(near[at]).astype(np.int64) if doubt is None else np.array([sum(map(int.__mul__, x, q.tolist())) for x in v[at].tolist()], object)
    order = np.lexsort((ids[at], *(-x for x in reversed(limbs(score)))))[:k]
    return at[order], score[order]


def top_k(data: DataFrame, queries: DataFrame, k: int = K, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products over ``data``, ties to the smaller vec_id.

    Both have vec_id and v (arrays of whole numbers); a row with the query's own id is no candidate.
    Fewer than k candidates give fewer rows.  Repeated candidates count each, repeated queries once.  An empty side
    gives no rows.  Ranks follow the exact scores; a score that a long can't hold is given as the nearest long.  Vectors
    of several lengths have no inner product and are a ValueError.
    """
    spark = data.sparkSession
    small_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    n, top, least, most = data.agg(F.count("*"), F.max(square), F.min(F.size("v")), F.max(F.size("v"))).first()
    asked_n, top_q, *sizes = queries.agg(F.count("*"), F.max(square), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or not asked_n:
        return empty
    if {*sizes, least, most} != {most}:
        raise ValueError(f"vectors have {min(least, *sizes)} to {max(most, *sizes)} components")
    block = block or min(BLOCK[1], max(BLOCK[0], n // 256))
    query_block = query_block or min(QUERY_BLOCK[1], max(QUERY_BLOCK[0], asked_n // 64))
    pivots = pivots_of(data, int(min(PIVOTS, max(2, n**0.5 / 8))))
    x = written(celled(data, pivots, float(top), True), "cells")
    q = written(celled(queries.distinct(), pivots, float(top), False), "query-cells")
    # summaries: some numbers for each cell
    order = Window.partitionBy("cell", "salt").orderBy("far")
    once = x.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("at"))  # of an id one row: among k + 1 ids at most one is the query's
    firsts = once.select("at.cell", "at.far", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn("i", F.row_number().over(order)).where(f"i <= {k + 1}")
    firsts = firsts.withColumn("j", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(f"j <= {k + 1}")
    nearest = {r[0]: sorted(r[1]) for r in firsts.groupBy("cell").agg(F.collect_list("far")).collect()}
    cells = {r["cell"]: r for r in x.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()}
    asked = {r["cell"]: r for r in q.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    between = np.sqrt(np.maximum((pivots**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * pivots @ pivots.T, 0))
    # rounding of a squared distance is below this, and that of the distance below its root; bounds are made of six of them
    margin = 6 * float(np.sqrt(64 * (most + 4) * 2.0**-53 * (top + top_q + (pivots**2).sum(1).max())))
    needs = {}
    for i, a in asked.items():
        # no query of cell i has its k-th neighbour (itself apart) farther than this
        bound = np.sort(np.concatenate([between[i, j] + a["far"] + np.array(f) for j, f in nearest.items()]))
        limit = (bound[k] if len(bound) > k else np.inf) * (1 + 1e-9) + margin
        needs[i] = {j for j, c in cells.items() if max(between[i, j] - a["far"] - c["far"], c["near"] - between[i, j] - a["far"]) <= limit}
    groups = grouped(needs, {i: a["n"] for i, a in asked.items()}, query_block)
    plan, member = [], []
    for g, own in enumerate(groups):
        member += [(i, g) for i in own]
        query_blocks = -(-sum(asked[i]["n"] for i in own) // query_block)
        plan += [(g, j, int(-(-cells[j]["n"] // block)), int(query_blocks)) for j in set().union(*(needs[i] for i in own))]
    # blocks of a cell; at most PIVOTS^2 rows
    pairs = F.broadcast(spark.createDataFrame(plan, "query_cell int, cell int, blocks int, query_blocks int"))
    x = x.join(pairs, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    x = x.withColumn("query_block", F.explode(F.expr("sequence(0, query_blocks - 1)")))
    group_of = F.broadcast(spark.createDataFrame(member, "cell int, query_cell int"))
    q = q.join(group_of, "cell").drop("cell").join(pairs, "query_cell").withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int"))
    q = q.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    key = ["query_cell", "query_block", "cell", "block"]

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "high", "middle", "low"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names}).astype("int64")
        ids, v = right["vec_id"].to_numpy(), np.array(right["v"].tolist(), np.int64)
        own, w = left["vec_id"].to_numpy(), np.array(left["v"].tolist(), np.int64)
        x, y = w.astype(np.float64), v.astype(np.float64)
        long_x, long_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        exact = long_x.max() * long_y.max() < 2.0**52  # then every sum on the way is a whole number that a double holds
        out = []
        for at in range(0, len(own), 256):
            for i, near in enumerate(x[at : at + 256] @ y.T, at):
                doubt = None if exact else (v.shape[1] + 8) * 2.0**-52 * long_x[i] * long_y
                pick, score = best_of(near, doubt, w[i], ids, v, own[i], k)
                out.append(np.stack([np.full(len(pick), own[i]), ids[pick], *limbs(score)], 1))
        return pd.DataFrame(np.concatenate(out), columns=names)

    partial = q.select(*key, "vec_id", "v").groupBy(*key).cogroup(x.select(*key, "vec_id", "v").groupBy(*key)).applyInPandas(solve, "query_id long, vec_id long, high long, middle long, low long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id"))
    edge = 1 << 63 - BITS
    held = ((F.col("high") == 0) & (F.col("middle") < edge)) | ((F.col("high") == -1) & (F.col("middle") >= (1 << BITS) - edge))
    score = F.when(held, F.shiftleft("middle", BITS).bitwiseOR(F.col("low"))).when(F.col("high") < 0, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return partial.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
