"""SimHash near-duplicates, found by meeting in the middle of the radius.

Two fingerprints within ``2 r`` bits of each other have a variant in common that is within ``r`` bits of
both.  So every fingerprint stands for all its variants within r (2,081 of them for r = 2), variants
are dealt by their first bits, and equal variants link their owners.  A fingerprint is sent only once to each
of the partitions that its variants go to (with b leading bits dealt: 1 + b + b(b-1)/2 of them); the variants that
fall there are enumerated in place.  Each partition verifies its collisions by bit count and returns a spanning forest of them, so that
a dense group of n fingerprints gives at most n - 1 links and not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .components import components

SHINGLE, SEED = 4, 42
DISTANCE = 4
#: Variants in a partition, about; and those that a worker sorts at a time.
VARIANTS = 2_000_000
#: Fingerprints in a part at most, about; and the bits by which a fuller one is dealt out.
CROWD, DEEPER = 200_000, 8
FINGERPRINTS = "doc_id long, fp long"


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = text.encode().lower().split()  # of bytes: A-Z alone, and white space \\x20 \\x09-\\x0D alone
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(whole, seed)], np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    start = end - n
    return np.array([digest(whole[a:b], seed) for a, b in zip(start[: 1 - size].tolist(), end[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; zero for a text without words."""
    h = shingle_hashes(text or "", size, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, columns: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row's whole text, and some of its columns as __c0, __c1, ...; null is an empty text."""
    small_batches(docs.sparkSession)
    plain = [f"__c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *plain])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), *[F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)])
    return rows.mapInArrow(run, ", ".join([FINGERPRINTS, *(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(columns, plain, strict=True))]))


@lru_cache(256)
def masks(bits: int, weight: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``weight`` (0 to 2) of them set."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    found = [np.zeros(1, np.uint64)]
    if weight >= 1:
        found.append(one)
    if weight >= 2:
        i, j = np.triu_indices(bits, 1)
        found.append(one[i] | one[j])
    return np.concatenate(found)


def variants(fps: np.ndarray, away: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The low ``bits`` bits of the variants that fall here, and their owners; ``away``: bits already changed."""
    low = fps & np.uint64((1 << bits) - 1)
    values, owners = [], []
    for w in range(radius + 1):
        own = np.flatnonzero(away == w)
        m = masks(bits, radius - w)
        values.append((low[own][:, None] ^ m[None, :]).ravel())
        owners.append(np.repeat(own, len(m)))
    return np.concatenate(values), np.concatenate(owners)


def amount(away: np.ndarray, bits: int, radius: int) -> int:
    return sum(int((away == w).sum()) * len(masks(bits, radius - w)) for w in range(radius + 1))


def collisions(fps: np.ndarray, away: np.ndarray, bits: int, radius: int, most: int = VARIANTS) -> np.ndarray:
    """Pairs of indices that chain the owners of each shared variant; shape (n, 2).

    More variants than ``most`` are taken in parts by their next bit, one part at a time.
    """
    if len(fps) < 2:
        return np.zeros((0, 2), np.int64)
    if amount(away, bits, radius) > most and bits > 4:
        found, next_ = [], np.uint64(bits - 1)
        side = (fps >> next_) & np.uint64(1)
        for half in (0, 1):
            there = away + (side != half)
            own = np.flatnonzero(there <= radius)
            found.append(own[collisions(fps[own], there[own], bits - 1, radius, most)])
        return np.unique(np.concatenate(found), axis=0)
    values, owners = variants(fps, away, bits, radius)
    room = max(1, int(len(fps) - 1).bit_length())
    # a cheap pass over shortened variants leaves the owners that may share one
    short = np.sort((values << np.uint64(room)) | owners.astype(np.uint64))
    key = short >> np.uint64(room)
    hit = np.flatnonzero(key[1:] == key[:-1])
    owner = np.uint64((1 << room) - 1)
    some = np.unique(np.concatenate([short[hit] & owner, short[hit + 1] & owner])).astype(np.int64)
    if not len(some):
        return np.zeros((0, 2), np.int64)
    del values, owners, short, key
    values, owners = variants(fps[some], away[some], bits, radius)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], some[owners[order]]
    hit = np.flatnonzero(values[1:] == values[:-1])
    return np.unique(np.sort(np.stack([owners[hit], owners[hit + 1]], 1), axis=1), axis=0)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The pairs that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
    return pairs[kept]


def dealt(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """Sends each row of part (the first ``depth`` bits of a variant), depth, away (bits in which these differ), fp, node to the parts that its variants' next ``bits`` bits make."""
    own = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    if "depth" in rows.columns:
        own = F.expr(f"shiftrightunsigned(shiftleft(fp, depth), {64 - bits})")
    else:
        rows = rows.select(F.lit(0).cast("long").alias("part"), F.lit(0).alias("depth"), F.lit(0).alias("away"), "fp", "node")
    flips = {w: masks(bits, radius - w).view(np.int64).tolist() for w in range(radius + 1)}
    lists = F.array(*[F.array(*map(F.lit, flips[w])) for w in range(radius + 1)])
    sent = rows.withColumn("own", own).withColumn("flip", F.explode(F.element_at(lists, F.col("away") + 1)))
    return sent.select(F.shiftleft("part", bits).bitwiseOR(F.col("own").bitwiseXOR(F.col("flip"))).alias("part"), (F.col("depth") + bits).alias("depth"), (F.col("away") + F.bit_count(F.col("flip"))).alias("away"), "fp", "node")


def links(fps: DataFrame, n: int, distance: int = DISTANCE, most: int = VARIANTS, crowd: int = CROWD) -> DataFrame:
    """(a, b): nodes whose fingerprints are within ``distance`` (4 at most), as forests that join all such.

    ``fps``: fp, node; both distinct.  ``n``: about how many rows it has.  A part with over ``crowd`` fingerprints, many of them alike
    in their first bits, is dealt out by more bits, again and again.  An odd distance compares all owners of a
    variant with each other, as two of them may be one bit too far apart; only even ones chain them.
    """
    if distance > 4 or distance < 0:
        raise ValueError("variants are enumerated for a half radius of 2 bits at most")
    radius = -(-distance // 2)
    first = min(40, max(0, (n * len(masks(64, radius)) // most)).bit_length())
    small_batches(fps.sparkSession)
    sent = dealt(fps, first, radius)
    for _ in range((56 - first) // DEEPER):
        crowded = sent.groupBy("depth", "part").count().where(F.col("count") > crowd).select("depth", "part", F.lit(True).alias("crowded"))
        if crowded.isEmpty():
            break
        crowded = crowded.checkpoint()
        some = crowded.count()
        met = sent.join(F.broadcast(crowded) if some <= 10_000 else crowded, ["depth", "part"], "left")
        sent = met.where("crowded IS NULL").drop("crowded").select("part", "depth", "away", "fp", "node").unionByName(dealt(met.where("crowded").drop("crowded"), DEEPER, radius))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["fp"].to_numpy().view(np.uint64)
        low, away = 64 - int(pdf["depth"].iloc[0]), pdf["away"].to_numpy().astype(np.int64)
        pairs = collisions(f, away, low, radius, most)
        near = np.bitwise_count(f[pairs[:, 0]] ^ f[pairs[:, 1]]) <= distance
        node = pdf["node"].to_numpy()
        if not near.all():
            pairs = far_checked(f, away, low, radius, distance)
        else:
            pairs = forest(pairs, len(f))
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return sent.groupBy("depth", "part").applyInPandas(run, "a long, b long").distinct()


def far_checked(fps: np.ndarray, away: np.ndarray, bits: int, radius: int, distance: int) -> np.ndarray:
    """For odd distances: every pair on a shared variant is compared, one variant's owners with another at a time."""
    values, owners = variants(fps, away, bits, radius)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    found, step = [], 1
    while True:
        hit = np.flatnonzero(values[step:] == values[:-step])
        if not len(hit):
            break
        a, b = owners[hit], owners[hit + step]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        found.append(np.unique(np.sort(np.stack([a[near], b[near]], 1), axis=1), axis=0))
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return forest(pairs, len(fps))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints within ``distance`` bits.

    Every row stays, in any number of copies; null texts are empty ones, texts without words have fingerprint
    zero and are linked like others.  Null ids never name a component unless all its ids are null.  With ``columns`` these
    of the rows come instead, and ``group``, a number of the component (a fingerprint in it).
    """
    own = written(fingerprints(docs, columns or ()), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    # nodes with no id at all, or one id on several fingerprints, are told apart by the fingerprint itself
    found = links(nodes.select("fp", F.col("fp").alias("node")), nodes.count(), distance)
    joined = components(found)
    group = joined.join(nodes.select(F.col("fp").alias("node"), F.col("node").alias("least")), "node").select(F.col("node").alias("fp"), "component", "least")
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(group.select("fp", "component"), "fp", "left").join(least, "component", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"), F.coalesce("component", "fp").alias("group"))
    rows = own.join(written(named, "components"), "fp")
    if columns is None:
        return rows.select("doc_id", "fp", "component_id")
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)], "group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
