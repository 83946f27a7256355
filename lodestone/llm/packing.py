"""Best-fit packing of tokenised documents into sequences, planned on counts of lengths.

Lengths are whole numbers up to the capacity, so all there is to decide is how many items of which
lengths share a sequence.  The plan is therefore made on a histogram with at most ``capacity`` rows,
whatever the size of the corpus:

1. Large items (over a third of the capacity) meet at most in pairs; from the longest down, each takes
   the longest other large item that still fits.
2. Smaller items, from the longest down, go into the smallest gap that holds them; new sequences are
   opened only when no gap does.

The plan's rows say "items number r0 to r1 of length n go to sequences s, s+1, ... at this offset,
so many to each"; items get their numbers within a length from counts of hashed buckets, so that a
length shared by a third of all items is numbered by many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .tokens import WORD_BPE, tokens

CAPACITY = 2048
END_ID = 0
#: Items of one length are numbered in so many independent buckets.
BUCKETS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def pieces(docs: DataFrame, path: str = WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of at most ``capacity`` ids of each document with its end id.

    Null and empty texts are the end id alone.  ``place`` tells rows with one doc_id apart: equal
    rows may share it, which only decides which of them comes first.
    """
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path, False)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            rows = []
            for doc, place, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), own.encode(texts), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), place))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("place")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first item, number of items, first sequence, items in each sequence, offset).

    The last sequence of a row may get fewer items.
    """
    used = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c > 0}
    rows, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    open_gaps: list[int] = []

    def take(n: int, items: int, first: int, each: int, offset: int) -> None:
        rows.append((n, used[n], items, first, each, offset))
        used[n] += items
        left[n] -= items

    def gap(size: int, first: int, many: int) -> None:
        if size > 0 and many > 0:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(open_gaps, size)
            gaps[size].append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n] > 0:
            mate = next((m for m in large if m <= capacity - n and (left[m] > 1 if m == n else left[m] > 0)), None)
            many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            take(n, many, sequences, 1, 0)
            if mate is not None:
                take(mate, many, sequences, 1, n)
            gap(capacity - n - (mate or 0), sequences, many)
            sequences += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n] > 0:
            at = bisect.bisect_left(open_gaps, n)
            if at < len(open_gaps):
                size = open_gaps[at]
                first, many = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], open_gaps[at]
                offset = capacity - size
            else:
                size, first, offset = capacity, sequences, 0
                many = -(-left[n] // (capacity // n))
                sequences += many
            each = min(size // n, left[n])
            full = min(many, left[n] // each)
            take(n, full * each, first, each, offset)
            gap(size - each * n, first, full)
            if full < many:
                rest = left[n] if left[n] < each else 0
                if rest:
                    take(n, rest, first + full, rest, offset)
                    gap(size - rest * n, first + full, 1)
                gap(size, first + full + bool(rest), many - full - bool(rest))
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, length, place (and others).

    ``parts`` is read twice and should be a written table.  The histogram on the driver has at most
    ``capacity`` rows.  An empty table gives an empty result.
    """
    spark = parts.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "place"), F.lit(buckets))
    parts = parts.withColumn("bucket", bucket)
    sizes = parts.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"), "count").checkpoint()
    counts = {r[0]: r[1] for r in starts.groupBy("length").agg(F.sum("count")).collect()}
    rows = plan(counts, capacity)
    by_length: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    for n, first, _, sequence, each, offset in rows:
        firsts, rest = by_length.setdefault(n, ([], []))
        firsts.append(first)
        rest.append((sequence, each, offset))
    packed = {n: (np.array(a, np.int64), np.array(b, np.int64)) for n, (a, b) in by_length.items()}
    plan_of = spark.sparkContext.broadcast(packed)
    numbered = parts.join(F.broadcast(starts.select("length", "bucket", "ahead")) if starts.count() <= capacity * buckets else starts, ["length", "bucket"]).withColumn(
        "item", F.col("ahead") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "place", "piece")) - 1
    )
    wanted = [c for c in parts.columns if c not in ("bucket",)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = plan_of.value
        for b in batches:
            length, item = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "item"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                firsts, rest = of[int(n)]
                row = np.searchsorted(firsts, item[own], "right") - 1
                place, slot = np.divmod(item[own] - firsts[row], rest[row, 1])
                sequence[own] = rest[row, 0] + place
                offset[own] = rest[row, 2] + slot * n
            kept = [b.column(b.schema.get_field_index(c)) for c in wanted]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*wanted, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name in wanted)
    return numbered.select(*wanted, "item").mapInArrow(run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str = WORD_BPE, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(written(pieces(docs, path, end_id, capacity), "pieces"), capacity).drop("place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
