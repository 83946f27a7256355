"""Byte-level BPE by a table of ranks, in two tiers.

Tier one: a minimal perfect hash over the vocabulary (levels of bit arrays; a key settles on the first
level where it is alone, and its number is the count of set bits before its own) resolves pre-tokens
that are vocabulary entries as they stand, many at once in numpy, and compares the entry's bytes.
Tier two: other pre-tokens are merged over linked bytes, a heap giving the lowest rank, leftmost first.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .memo import Memo

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Gives each of n distinct 64-bit keys its own number in 0..n-1; any number to other keys, or -1."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels, left = [], np.asarray(keys, np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys of the perfect hash must be distinct")
        before = 0
        while len(left):
            size = max(64, int(len(left) * room))
            at = (mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            number = np.cumsum(alone) - 1 + before
            self.levels.append((alone, number))
            left, before = left[~alone[at]], before + int(alone.sum())
        self.n = before

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (alone, number) in enumerate(self.levels):
            at = (mixed(keys[open_], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[open_[hit]] = number[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is joined first, the leftmost of equals."""
    n = len(word)
    end = list(range(1, n + 1))  # piece at i is word[i:end[i]]
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, mid, stop = pop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two pieces has changed
        end[i] = stop
        end[mid] = -1
        if stop < n:
            before[stop] = i
            r = get(word[i : end[stop]])
            if r is not None:
                push(heap, (r, i, stop, end[stop]))
        j = before[i]
        if j >= 0:
            r = get(word[j:stop])
            if r is not None:
                push(heap, (r, j, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class Coder:
    """Encodes and decodes by a file of ranks; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.entries = [b""] * (max(self.ranks.values()) + 1)
        for entry, rank in self.ranks.items():
            self.entries[rank] = entry
        keys = list(self.ranks)
        hashes = self.hashes(keys)
        self.perfect = PerfectHash(hashes)
        self.slot_id = np.empty(len(keys), np.int64)
        self.slot_id[self.perfect(hashes)] = [self.ranks[k] for k in keys]
        self.find = regex.compile(pattern).findall
        self.ids_of = [i.to_bytes(4, "little") for i in range(len(self.entries))]
        self.pieces: dict[str, bytes] = {}
        self.memo = Memo(self.encode_parts, 110 << 20)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, keys), np.uint64, len(keys))

    def resolve(self, tokens: list[str]) -> None:
        """Puts the ids of new pre-tokens into ``pieces``."""
        as_bytes = [t.encode() for t in tokens]
        slots = self.perfect(self.hashes(as_bytes))
        ids = np.where(slots >= 0, self.slot_id[slots], 0).tolist()
        entries, ids_of, ranks, pieces = self.entries, self.ids_of, self.ranks, self.pieces
        for token, word, i, slot in zip(tokens, as_bytes, ids, slots.tolist(), strict=True):
            if slot >= 0 and entries[i] == word:
                pieces[token] = ids_of[i]
            else:
                pieces[token] = b"".join([ids_of[x] for x in merged(word, ranks)])

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        found = [self.find(p) for p in parts]
        if len(self.pieces) > 400_000:
            self.pieces.clear()
        new = {t for tokens in found for t in tokens} - self.pieces.keys()
        if new:
            self.resolve(list(new))
        get = self.pieces.__getitem__
        return [b"".join(map(get, tokens)) for tokens in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def coder(path: str) -> Coder:
    """One for each Python worker."""
    return Coder(path)


OUT = "doc_id long, n_tokens long, ids binary"


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of each row's whole text.

    Null and empty texts have no ids.  Repeated rows and null ids stay; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            ids = own.encode(["" if t is None else t for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def decoded(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows of doc_id, n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.decode(x) for x in b.column(2).to_pylist()], pa.binary())], [*b.schema.names, "decoded"])

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, OUT + ", decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
