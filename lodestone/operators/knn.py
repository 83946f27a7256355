"""Exact nearest neighbours: a stated set of queries against all rows, in blocks.

Queries (checked to be few enough to broadcast) meet each Arrow batch of the table in one matrix product;
a batch keeps k rows for each query, a partition merges its batches, and a window over the partial lists ranks the rest.  More
queries than fit are taken in several such sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import TINY
from lodestone.session import ship

#: Numbers (of 4 bytes) in one broadcast set of queries.
QUERY_NUMBERS = 4 << 20


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; rows must be valid vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) != dim * len(column):
        raise ValueError(f"vectors must have {dim} components")
    return flat.reshape(len(column), dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(size > TINY, x / np.where(size > TINY, size, 1), x)


def distances(queries: np.ndarray, x: np.ndarray, space: str) -> np.ndarray:
    if space == "l2":
        return np.maximum((queries**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * queries @ x.T, 0)
    q, y = np.sqrt((queries**2).sum(1)), np.sqrt((x**2).sum(1))
    size = q[:, None] * y[None, :]
    similar = np.clip(queries @ x.T / np.where(size < TINY, 1, size), -1, 1)
    return np.where(size < TINY, 1.0, 1 - similar)


def best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances of each row, ties to smaller ids."""
    if d.shape[1] <= k:
        return np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(d), k), np.int64)
    for i, row in enumerate(d):
        at = np.flatnonzero(row <= limit[i])
        out[i] = at[np.lexsort((ids[at], row[at]))][:k]
    return out


def knn(table: DataFrame, queries: DataFrame, k: int, space: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """query_id, rank (from 1), the table's id, distance: the k nearest rows of each query, ties to the smaller id.

    Fewer rows than k give them all.  Errors: k below 1, an empty table, vectors of unlike lengths or with NaN or infinite parts.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if space not in ("cosine", "l2"):
        raise ValueError(f"space must be cosine or l2, not {space!r}")
    spark = table.sparkSession
    ship(spark)
    first = table.select(F.size(vector)).where(F.col(vector).isNotNull()).first()
    if first is None:
        raise ValueError("the index is empty")
    dim = first[0]
    id_type = table.schema[id_col].dataType.simpleString()
    n = queries.count()
    sets = max(1, -(-n * dim // QUERY_NUMBERS))
    numbered = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("query"))
    found = [one_set(table, numbered if sets == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i), k, space, id_col, vector, dim) for i in range(sets)]
    partial = found[0]
    for more in found[1:]:
        partial = partial.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    ranked = partial.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").cast(id_type).alias(id_col), "distance")


def one_set(table: DataFrame, queries: DataFrame, k: int, space: str, id_col: str, vector: str, dim: int) -> DataFrame:
    rows = queries.toArrow()
    q = matrix(rows.column(1).combine_chunks(), dim) if len(rows) else np.zeros((0, dim))
    if not np.isfinite(q).all():
        raise ValueError("a query is not finite")
    shipped = table.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, own = shipped.value
        ids, d = np.zeros(0, np.int64), np.zeros((len(own), 0))
        kept_ids, kept = np.zeros((len(own), 0), np.int64), d
        for b in batches:
            ids = b.column(0).to_numpy()
            x = matrix(b.column(1), dim)
            if not np.isfinite(x).all():
                raise ValueError("a vector of the index is not finite")
            for at in range(0, len(own), 512):
                part = slice(at, min(at + 512, len(own)))
                d = distances(own[part], x, space)
                pick = best(d, ids, k)
                if at == 0:
                    new_ids, new = np.empty((len(own), pick.shape[1]), np.int64), np.empty((len(own), pick.shape[1]))
                new_ids[part], new[part] = ids[pick], np.take_along_axis(d, pick, 1)
            if not len(own):
                continue
            kept_ids, kept = np.concatenate([kept_ids, new_ids], 1), np.concatenate([kept, new], 1)
            order = np.lexsort((kept_ids, kept), axis=1)[:, :k]
            kept_ids, kept = np.take_along_axis(kept_ids, order, 1), np.take_along_axis(kept, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, kept.shape[1])), pa.array(kept_ids.ravel()), pa.array(kept.ravel())], ["query_id", "id", "distance"])

    return table.select(F.col(id_col).cast("long"), F.col(vector)).mapInArrow(run, "query_id long, id long, distance double")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """query_id, recall: the part of each query's true k that was found; 1 where there is no truth."""
    true = truth.where(F.col("rank") <= k).select("query_id", id_col).distinct()
    hits = true.join(found.where(F.col("rank") <= k).select("query_id", id_col).distinct().withColumn("hit", F.lit(1)), ["query_id", id_col], "left")
    scored = hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    every = found.select("query_id").union(truth.select("query_id")).distinct()
    return every.join(scored, "query_id", "left").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"))
