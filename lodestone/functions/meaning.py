"""Embeddings that know which words mean alike: they stand among the same words.

Pairs of words within a few places of each other are counted in Spark, over all texts, for a bounded vocabulary of the most frequent words.  Positive pointwise mutual information
makes a sparse symmetric matrix of the counts, and a randomised decomposition (Halko and others, 2011) gives each word a short vector: a handful of products of the
matrix, each a Spark job over the pairs by row, with a thin matrix of a bounded size that is broadcast.  A text is the sum of its words' vectors, the frequent ones weighing little.
All counts are whole numbers and rows are summed in a fixed order, so training again gives the same vectors.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embedding import WORD
from lodestone.session import ship

#: Words of the vocabulary at most; places between two words that count as near; numbers of the thin matrix at most.
WORDS, WINDOW, NUMBERS = 20_000, 5, 1 << 23
#: More columns than asked for, and rounds, which make the decomposition good.
MORE, ROUNDS = 16, 3
#: A word of this part of all words has half the weight of a rare one.
COMMON = 1e-3
#: Different words, and pairs, that a task holds before it passes them on.
HELD = 1 << 20


@dataclass
class Model:
    words: list[str]
    vectors: np.ndarray
    weights: np.ndarray

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]


class MeaningEmbedder:
    """A text's vector is that of its known words, of unit length; zeros where it has none."""

    def __init__(self, model: Model):
        self.dim = model.dim
        self.place = {w: i for i, w in enumerate(model.words)}
        self.vectors = model.vectors.astype(np.float64) * model.weights[:, None]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            at = [i for w in WORD.findall(text.lower()) if (i := self.place.get(w)) is not None]
            if at:
                places, n = np.unique(at, return_counts=True)
                row += n @ self.vectors[places]
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(size > 1e-12, size, 1)).astype(np.float32)


class Meaning:
    """Makes the embedder of a model, which is sent to each executor once."""

    def __init__(self, spark: SparkSession, model: Model):
        self.shipped = spark.sparkContext.broadcast(model)  # WORDS x dim numbers at most
        self.key = hashlib.md5(model.vectors.tobytes() + "\n".join(model.words).encode(), usedforsecurity=False).hexdigest()

    def __call__(self) -> MeaningEmbedder:
        return MeaningEmbedder(self.shipped.value)

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return isinstance(other, Meaning) and self.key == other.key


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each word stands in all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(WORD.findall((t or "").lower()))
                if len(found) > HELD:
                    yield told()
                    found.clear()
        yield told()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, words: int = WORDS, least: int = 2) -> list[tuple[str, int]]:
    """The most frequent words with their counts, ties in the order of the words."""
    return [tuple(r) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).collect()]


def near_pairs(docs: DataFrame, known: list[str], window: int = WINDOW, text: str = "text") -> DataFrame:
    """i, j (places in ``known``, i not over j) and n: pairs of known words that have fewer than ``window`` known ones between them, near ones counting more."""
    spark = docs.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast({w: i for i, w in enumerate(known)})
    size = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shipped.value
        codes, n, held = [], [], 0

        def told() -> pa.RecordBatch:
            every, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(n)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((every // size).astype(np.int32)), pa.array((every % size).astype(np.int32)), pa.array(total)], ["i", "j", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                ids = np.array([i for w in WORD.findall((t or "").lower()) if (i := place.get(w)) is not None], np.int64)
                for d in range(1, min(window, len(ids) - 1) + 1):
                    a, z = ids[:-d], ids[d:]
                    own, many = np.unique(np.minimum(a, z) * size + np.maximum(a, z), return_counts=True)
                    codes.append(own)
                    n.append(many * (window + 1 - d))
                    held += len(own)
                if held > HELD:
                    yield told()
                    codes, n, held = [], [], 0
        if codes:
            yield told()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def product(matrix: DataFrame, thin: np.ndarray) -> np.ndarray:
    """``matrix`` (i, j, value; a partition has whole rows) times a thin matrix: as many rows come to the driver as that has."""
    shipped = matrix.sparkSession.sparkContext.broadcast(thin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, rows = shipped.value, {}
        for b in batches:
            i, j, v = (b.column(c).to_numpy() for c in range(3))
            for at in range(0, len(i), 4096):
                part = slice(at, at + 4096)
                first = np.flatnonzero(np.diff(i[part], prepend=-1))
                sums = np.add.reduceat(v[part, None] * right[j[part]], first)
                for row, own in zip(i[part][first].tolist(), sums, strict=True):
                    rows[row] = rows[row] + own if row in rows else own
        if rows:
            flat = np.array(list(rows.values()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), lists], ["i", "row"])

    out = np.zeros_like(thin)
    for r in matrix.mapInArrow(run, "i int, row array<double>").toArrow().to_pylist():
        out[r["i"]] = r["row"]
    return out


def train(docs: DataFrame, dim: int = 128, words: int = WORDS, window: int = WINDOW, seed: int = 0, text: str = "text") -> Model:
    """Over all texts; null and empty ones have no words.  Errors: no word that occurs twice; a vocabulary and dim whose thin matrix is too large."""
    known = vocabulary(word_counts(docs, text), words)
    if not known:
        raise ValueError("there are no words to learn from")
    width = min(dim + MORE, len(known))
    if len(known) * max(dim, width) > NUMBERS:
        raise ValueError(f"{len(known)} words by {max(dim, width)} columns are over {NUMBERS} numbers")
    spark = docs.sparkSession
    pairs = near_pairs(docs, [w for w, _ in known], window, text).persist()
    try:
        both = pairs.select("i", "j", "n").unionByName(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
        total = dict(both.groupBy("i").agg(F.sum("n")).collect())  # a row for each known word at most
        every = float(sum(total.values()))
        sums = F.broadcast(spark.createDataFrame([(i, float(n)) for i, n in sorted(total.items())] or [(0, 1.0)], "k int, total double"))
        value = F.log(F.col("n") * every / (F.col("left") * F.col("right")))
        matrix = both.join(sums.select(F.col("k").alias("i"), F.col("total").alias("left")), "i").join(sums.select(F.col("k").alias("j"), F.col("total").alias("right")), "j").select("i", "j", value.alias("v")).where("v > 0")
        matrix = matrix.repartition("i").sortWithinPartitions("i", "j").persist()
        thin = np.random.default_rng(seed).normal(size=(len(known), width))
        for _ in range(ROUNDS):
            thin, _ = np.linalg.qr(product(matrix, thin))
        values, turn = np.linalg.eigh(thin.T @ product(matrix, thin))
        matrix.unpersist()
    finally:
        pairs.unpersist()
    best = np.argsort(-np.abs(values), kind="stable")[:dim]
    vectors = (thin @ turn[:, best]) * np.sqrt(np.abs(values[best]))
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    if vectors.shape[1] < dim:
        vectors = np.concatenate([vectors, np.zeros((len(known), dim - vectors.shape[1]))], 1)
    n = np.array([c for _, c in known], float)
    return Model([w for w, _ in known], vectors.astype(np.float32), COMMON / (COMMON + n / n.sum()))


def save(spark: SparkSession, model: Model, folder: str) -> None:
    rows = [(i, w, float(x), v.tolist()) for i, (w, x, v) in enumerate(zip(model.words, model.weights, model.vectors, strict=True))]
    spark.createDataFrame(rows, "place int, word string, weight double, vector array<float>").write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> Model:
    rows = spark.read.parquet(folder).orderBy("place").collect()  # WORDS at most
    return Model([r["word"] for r in rows], np.array([r["vector"] for r in rows], np.float32), np.array([r["weight"] for r in rows]))
