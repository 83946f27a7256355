"""Embeddings of texts by Arrow batches, one model for each Python worker.

The default model is signed feature hashing of words: deterministic and without files, but it knows no
meanings.  A neural one is used where its library and files are installed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

BATCH = 64
WORD = re.compile(r"\w+")


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One float32 row of unit length for each text; zeros for a text without words."""


class HashEmbedder:
    """A word's number is the first 32 bits of its MD5: the last bit is its sign, the others give its component."""

    def __init__(self, dim: int = 384, seed: int = 0):
        self.dim, self.seed = dim, seed
        self.known: dict[str, int] = {}

    def number(self, word: str) -> int:
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = h = int.from_bytes(md5((f"{self.seed} {word}" if self.seed else word).encode(), usedforsecurity=False).digest()[:4], "big")
        return h

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for row, text in zip(out, texts, strict=True):
            h = np.array([self.known[w] if w in self.known else self.number(w) for w in WORD.findall(text.lower())], np.int64)
            row += np.bincount((h >> 1) % self.dim, 1 - 2.0 * (h & 1), self.dim)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(size > 0, size, 1)).astype(np.float32)


class SentenceEmbedder:
    """``sentence-transformers``, from local files alone."""

    def __init__(self, name: str):
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(name, local_files_only=True)
        self.dim = self.model.get_sentence_embedding_dimension()

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts, batch_size=BATCH, normalize_embeddings=True), np.float32)


@lru_cache(2)
def cached(make: Callable[[], Embedder]) -> Embedder:
    return make()


class Hashing:
    """Makes HashEmbedder; equal ones share a worker's model."""

    def __init__(self, dim: int = 384, seed: int = 0):
        self.key = (dim, seed)

    def __call__(self) -> HashEmbedder:
        return HashEmbedder(*self.key)

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return isinstance(other, Hashing) and self.key == other.key


def one_by_one(model: Embedder, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
    """Vectors, and of texts on which the model fails what it said; such vectors are zeros."""
    out, said = np.zeros((len(texts), model.dim), np.float32), []
    for i, t in enumerate(texts):
        try:
            out[i] = model.encode([t])[0]
            said.append(None)
        except Exception as e:
            said.append(f"{type(e).__name__}: {e}")
    return out, said


def embedded(rows: DataFrame, make: Callable[[], Embedder], dim: int, text: str = "text", name: str = "vector", batch: int = BATCH, error: str | None = None) -> DataFrame:
    """Adds the vector column; null texts are empty ones.  A model of another dim is an error.

    ``error``: a column for what went wrong with a row; its vector is null then, and all other rows are embedded.  Without it a failure ends the job.
    """
    if batch < 1:
        raise ValueError("batch must be at least 1")
    ship(rows.sparkSession)
    names = [f"c{i}" for i in range(len(rows.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cached(make)
        if model.dim != dim:
            raise ValueError(f"the model gives {model.dim} components, {dim} are expected")
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts, said = [t or "" for t in part.column(0).to_pylist()], None
                try:
                    x = model.encode(texts)
                except Exception:
                    if error is None:
                        raise
                    x, said = one_by_one(model, texts)
                said = said or [None] * len(x)
                bad = np.array([e is not None for e in said])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()), mask=pa.array(bad) if bad.any() else None)
                more = [pa.array(said, pa.string())] if error else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], vectors, *more], [*names, name, *[error] * len(more)])

    schema = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in zip(rows.columns, names, strict=True))
    done = rows.select(F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)]).mapInArrow(run, f"{schema}, {name} array<float>" + (f", {error} string" if error else ""))
    return done.select(*[F.col(n).alias(c) for c, n in zip(rows.columns, names, strict=True)], name, *[error] * bool(error))
