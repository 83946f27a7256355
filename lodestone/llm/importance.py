"""Target-distribution importance resampling by hashed n-gram counts.

Features are runs of words, hashed by CRC-32.  A word's CRC is computed once; that of a run is composed from its words':
crc(A + B) = shift(crc(A), |B|) xor crc(B), where shift, "so many zero bytes follow", is linear over GF(2).  The matrix for a length is a product
of squares of the one for a single byte, and is applied to whole arrays through four tables of its columns' sums.  No run is ever made as a string.

Counts by bucket, of the corpus and of the target, are histograms of a fixed size; they give each bucket a gain.  A document's weight is the sum
over its features, noise by a hash of its id makes the highest scores a draw by weight without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lodestone.operators.incremental import numbered

from .common import small_batches, table, written

BUCKETS = 10_000
#: Words of a run, least and most.
RUN = (1, 1)
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: The polynomial of CRC-32, low bit first.
POLYNOMIAL = 0xEDB88320

#: A-Z become a-z; other bytes that are no part of a word become spaces.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that a worker remembers.
MEMO = 1 << 20
#: Bytes of a text, about, whose words are cut out at once.
STRETCH = 1 << 22


def times(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The matrix (its 32 columns as numbers) applied to each number."""
    out = np.zeros_like(columns)
    for bit in range(32):
        out ^= np.where(columns >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(64)
def squared(power: int) -> np.ndarray:
    """The matrix for 2^power zero bytes."""
    if power:
        half = squared(power - 1)
        return times(half, half)
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        one = one >> np.uint32(1) ^ np.where(one & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return one


@lru_cache(4096)
def shift_tables(length: int) -> np.ndarray:
    """What each of the four bytes of a CRC becomes when ``length`` zero bytes follow: 4 x 256 numbers."""
    matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(length.bit_length()):
        if length >> power & 1:
            matrix = times(squared(power), matrix)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([times(matrix, values << np.uint32(8 * i)) for i in range(4)])


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs after so many zero bytes each."""
    out = np.empty_like(crcs)
    sizes, place = np.unique(lengths, return_inverse=True)
    for i, n in enumerate(sizes.tolist()):
        at = place == i
        x, tables = crcs[at], shift_tables(n)
        out[at] = tables[0][x & np.uint32(255)] ^ tables[1][x >> np.uint32(8) & np.uint32(255)] ^ tables[2][x >> np.uint32(16) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]
    return out


SPACE = np.uint32(zlib.crc32(b" "))


class Words(dict):
    """word (bytes) -> its CRC and length in one number; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = zlib.crc32(word) | len(word) << 32
        return found

    def features(self, text: str, least: int, most: int) -> tuple[np.ndarray, int]:
        """The CRCs of all runs of ``least`` to ``most`` words, repeats too, and how many words there are."""
        data = text.encode().translate(PLAIN)
        parts, at = [], 0
        while at < len(data):
            end = data.find(b" ", at + STRETCH) if len(data) - at > STRETCH else -1
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            at = end
        both = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        crcs, lengths = (both & 0xFFFFFFFF).astype(np.uint32), both >> 32
        found, run = [], crcs
        # " word" by the same algebra; a run grows by it
        spaced = shifted(np.full(len(crcs), SPACE), lengths) ^ crcs if most > 1 else crcs
        for n in range(1, min(most, len(both)) + 1):
            if n > 1:
                run = shifted(run[:-1], lengths[n - 1 :] + 1) ^ spaced[n - 1 :]
            if n >= least:
                found.append(run)
        return np.concatenate(found) if found else np.zeros(0, np.uint32), len(both)


def histogram(rows: DataFrame, run: tuple[int, int] = RUN, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has some.  A partition sends one histogram."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    total += np.bincount(words.features(t, *run)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    parts = rows.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of (t + 1)(S + buckets) / (s + 1)(T + buckets)) for each bucket, from two histograms of ``buckets`` rows at most."""
    counts = []
    for rows in (corpus, target):
        own = [0] * buckets
        for bucket, n in rows.collect():
            own[bucket] = n
        counts.append(own)
    (s, t), (all_s, all_t) = counts, map(sum, counts)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(all_s + buckets) / (float(a + 1) * float(all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: tuple[int, int] = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, n_words, weight and place (a number for each row) of whole texts."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), shipped.value
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            found = [words.features(t or "", *run) for t in b.column(1).to_pylist()]
            weights = [int(own[f % np.uint32(len(own))].sum()) for f, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in ([len(f) for f, _ in found], [n for _, n in found], weights, range(place, place + len(found))))], ["id", "n_features", "n_words", "weight", "place"]
            )
            place += len(found)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(weigh, "id long, n_features long, n_words long, weight long, place long")


def noise(id_, seed: int):
    """floor of 1000 times a Gumbel-distributed number by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, run: tuple[int, int] = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank (all long) of each row of ``docs``; rank is null where a row isn't drawn.

    Of the N rows with at least ``least_words`` words the floor(percent N / 100) with the highest scores are drawn, ties to the smaller id; null
    ids have the hash of an empty id and come before others in ties.  Repeated rows count and are drawn each, in any order among themselves.
    Null and empty texts have no features and weight zero.  An empty target makes all gains depend on the corpus alone.  Other columns are ignored.
    """
    gain = gains(histogram(docs, run, buckets, text_col), histogram(target, run, buckets, text_col), buckets)
    rows = weighed(docs, gain, run, id_col, text_col)
    rows = written(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    fit = rows.where(F.col("n_words") >= least_words)
    most = fit.count() * percent // 100
    if most:
        order = fit.select((-F.col("score")).alias("down"), "id", "place", "n_features", "weight", "score")
        ranked = numbered(order, ["down", "id", "place"], 1, "rank")
        drawn = ranked.select("id", "n_features", "weight", "score", F.when(F.col("rank") <= most, F.col("rank").cast("long")).alias("rank"))
        rows = drawn.unionByName(rows.where(F.col("n_words") < least_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    else:
        rows = rows.select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return rows.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: a table for one byte, made by its rule, then a fold over a word's bytes.
STEP = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END"
SQL = f"""
WITH RECURSIVE steps(b, n, c) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, n + 1, {STEP} FROM steps WHERE n < 8),
bytes AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
texts AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
target AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
found AS (SELECT row, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
wanted AS (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM target),
words AS (SELECT DISTINCT word, hex(word) AS h FROM (SELECT word FROM found UNION ALL SELECT word FROM wanted)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket FROM words, bytes),
corpus AS (SELECT bucket, count(*) AS s FROM found JOIN hashed USING (word) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM corpus) + {BUCKETS} AS DOUBLE)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM aim) + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM corpus FULL JOIN aim USING (bucket)),
weights AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM found JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""
