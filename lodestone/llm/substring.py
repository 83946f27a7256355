"""Exact removal of passages that already stand earlier in the corpus, by a compacted De Bruijn graph.

A window of ``k`` words is an edge of the graph, from the node of its first k - 1 words to that of its last k - 1.  Only
edges that occur more than once matter.  A node's anchor is the smallest hash among its ``ANCHOR``-word grams; equal
nodes have equal anchors, and neighbouring nodes mostly share one.

1. Anchors.  A few for each document go through a shuffle; those that occur once take their nodes out of the graph.
2. Buckets.  Nodes that follow each other and share an anchor travel in one row with all edges that touch them, so a bucket knows
   every edge of its nodes.  There the smallest (doc_id, start) of an edge becomes its source, and a node
   through which just one repeated edge comes in and one goes out is nonbranching.  Later occurrences of edges that follow each
   other over such nodes, with sources that follow each other, are one piece.
3. Paths and spans.  Pieces of one document meet where one ends and the next begins: over a nonbranching node they are one path of
   the graph, and paths whose sources follow each other too are one span.
4. Verification.  Each span is joined with the words at its source's coordinates, by a digest of the words in either document;
   only spans that agree take words away.  One that doesn't (two windows with one hash) makes the whole search run
   again with other hashes, so the result never rests on a hash.

Frequent anchors are known with their counts.  They are marked by a broadcast of at most ``HEAVY`` of them, and their buckets are
salted: each salt finds its own edges, these meet again by edge and node, and each salt gets back what holds for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import clean_shuffles, dropped, numbered_columns, shuffle_partitions, small_batches, table, with_added, with_names, written

WINDOW, ANCHOR = 20, 8
#: An anchor with more occurrences has its bucket dealt out by a salt, about so many occurrences to each.
HOT = 1_000
#: Anchors with over one in so many of all occurrences, so at most so many of them, are marked by a broadcast.
HEAVY = 1_000
#: Nodes in a row at most, bytes of a row about, and of a partition.
RUN, ROW_BYTES, PART_BYTES = 4096, 160, 32 << 20
#: Edges that a worker handles at a time, about.
EDGES = 200_000
#: Searches before giving up; each has other hashes.
TRIES = 4
NO_ID = -(1 << 63)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Words(dict):
    """word -> 64-bit hash, emptied now and then."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int, by: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= by
        out += h[i : i + n]
    return mixed(out)


def extreme(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (np.minimum or np.maximum) of each run of ``width`` values; each step doubles the runs."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: white space is \\x20 \\x09-\\x0D alone


def new_values(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


class Texts:
    """The words of many texts in one array.  Grams that reach into the next text are masked by ``inside``."""

    def __init__(self, texts: list[str | None], known: Words, k: int):
        lists = [words_of(t) for t in texts]
        self.size = np.fromiter(map(len, lists), np.int64, len(lists))
        self.hashes = known.hashes([w for words in lists for w in words])
        self.text = np.repeat(np.arange(len(lists)), self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.left = self.size[self.text] - (np.arange(len(self.text)) - self.begin[self.text])  # words from here to the text's end
        self.k = k

    def inside(self, n: int, size: int) -> np.ndarray:
        """For the first ``n`` places whether ``size`` words from there are of one text, which has a window."""
        return (self.left[:n] >= size) & (self.size[self.text[:n]] >= self.k)

    def anchors(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor of each node, whether the node is within one text, grams)."""
        g = grams(self.hashes, m, P2)
        value = extreme(g, self.k - m, np.minimum)
        return value, self.inside(len(value), self.k - 1), g


def anchors(docs: DataFrame, k: int = WINDOW, m: int = ANCHOR, seed: int = 0) -> DataFrame:
    """(h, key): each place where a document has an anchor.  ``docs``: key, text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(seed)
        for b in batches:
            t = Texts(b.column(1).to_pylist(), known, k)
            if len(t.hashes) < k:
                continue
            value, inside, g = t.anchors(m)
            # a gram is an anchor where it is the smallest of some node, which is then the largest of the smallest around it
            pad = np.zeros(k - m - 1, np.uint64)
            at = np.flatnonzero(extreme(np.concatenate([pad, np.where(inside, value, 0), pad]), k - m, np.maximum) == g)
            at = at[g[at] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), b.column(0).take(pa.array(t.text[at]))], ["h", "key"])

    return docs.select("key", "text").mapInArrow(run, "h long, key long")


def marked(docs: DataFrame, k: int, m: int, seed: int) -> tuple[DataFrame, int]:
    """(key, marks: the document's anchors that occur more than once, and how many salts each has), and the occurrences of all such anchors."""
    found = written(anchors(docs, k, m, seed), "anchors")
    often = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", "n", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "repeated-anchors")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") > max(HOT, total // HEAVY)
    near = found.join(F.broadcast(often.where(heavy).select("h", F.col("salts").alias("many"))), "h", "left")
    light = near.where("many IS NULL").drop("many").join(often.where(~heavy).select("h", "salts"), "h")
    both = near.where("many IS NOT NULL").select("h", "key", F.col("many").alias("salts")).unionByName(light)
    marks = written(both.groupBy("key").agg(F.collect_set(F.struct("h", "salts")).alias("marks")), "marks")
    dropped(found, often)
    return marks, total


RUNS = "h long, salt int, salts int, doc long, start int, row long, lead int, edges binary, nodes binary"


def binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of so many values."""
    offsets = np.concatenate([[0], np.cumsum(size * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def stretches(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of many stretches, one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def runs(docs: DataFrame, k: int, m: int, seed: int, bits: int) -> DataFrame:
    """A row for each stretch of nodes with one marked anchor: ``edges`` are the hashes of all edges that touch its nodes.

    ``start``: of the first edge; ``lead`` is 1 if that edge only leads to the first node.  ``docs``: doc, row, text, marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(seed)
        for b in batches:
            doc, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            t = Texts(b.column(2).to_pylist(), known, k)
            if len(t.hashes) < k:
                continue
            value, inside, _ = t.anchors(m)
            text, at = t.text[: len(value)], np.arange(len(value)) - t.begin[t.text[: len(value)]]
            first = new_values(value) | new_values(text) | (at % RUN == 0)
            first[1:] |= ~inside[:-1]
            begin = np.flatnonzero(first & inside)
            stop = np.flatnonzero(np.concatenate([first[1:] | ~inside[1:], [True]]) & inside) + 1
            # marks of all texts in one sorted array; a node's mark is looked up by anchor and text
            of = np.repeat(np.arange(len(doc)), np.diff(b.column(3).offsets.to_numpy()))
            marks = b.column(3).flatten()
            name = mixed(marks.field(0).to_numpy().view(np.uint64) + of.astype(np.uint64) * P3)
            order = np.argsort(name)
            name, salts = name[order], marks.field(1).to_numpy()[order]
            asked = mixed(value[begin] + text[begin].astype(np.uint64) * P3)
            place = np.minimum(np.searchsorted(name, asked), len(name) - 1)
            own = name[place] == asked
            begin, stop, many, text = begin[own], stop[own], salts[place[own]].astype(np.int64), text[begin[own]]
            if not len(begin):
                continue
            edge, node = grams(t.hashes, k, P1), (grams(t.hashes, k - 1, P3) >> np.uint64(32)).astype(np.uint32)
            if bits < 64:
                edge &= np.uint64((1 << bits) - 1)
            lead = np.minimum(at[begin], 1)
            start = begin - lead
            n_edges = np.minimum(stop, t.begin[text] + t.size[text] - k + 1) - start
            spread = (mixed(doc[text].view(np.uint64) * P1 + row[text].view(np.uint64) * P2 + at[begin].astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
            columns = (value[begin].view(np.int64), (spread % many).astype(np.int32), many.astype(np.int32), doc[text], (at[begin] - lead).astype(np.int32), row[text], lead.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binary(stretches(edge, start, n_edges), n_edges), binary(stretches(node, begin, stop - begin), stop - begin)], [x.split()[0] for x in RUNS.split(", ")])

    return docs.select("doc", "row", "text", "marks").mapInArrow(run, RUNS)


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all rows, how many each has) of a column made by ``binary``."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy() if data is not None else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize


class Bucket:
    """Rows of ``runs``, whole buckets of them in the order of h, salt, doc and start, as flat arrays of edges and nodes."""

    def __init__(self, h, salt, doc, start, row, lead, edges: pa.Array, nodes: pa.Array):
        again = np.zeros(len(h), bool)  # rows that repeat the one before: the same document twice
        if len(h):
            again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in (h, salt, doc, start, row)])
        self.edge, size = flat(edges, "<u8")
        self.node, n_nodes = flat(nodes, "<u4")
        self.h, self.salt, self.again = h, salt, again
        self.r = np.repeat(np.arange(len(h)), size)
        begin = np.cumsum(size) - size
        self.j = np.arange(len(self.r)) - begin[self.r]
        self.doc, self.row, self.pos = doc[self.r], row[self.r], start[self.r].astype(np.int64) + self.j
        self.own = (self.j >= lead[self.r]) & ~again[self.r]  # goes out of a node of this bucket
        of = np.repeat(np.arange(len(h)), n_nodes)
        first = np.cumsum(n_nodes) - n_nodes
        t = np.arange(len(of)) - first[of] + lead[of]
        self.node_row = of
        self.out = np.where(t < size[of], begin[of] + t, -1)  # edge that goes out of each node, or -1
        self.into = np.where(t > 0, begin[of] + t - 1, -1)
        self.left = np.where(self.j >= lead[self.r], first[self.r] + self.j - lead[self.r], -1)  # node an edge comes from, or -1
        right = first[self.r] + self.j + 1 - lead[self.r]
        self.right = np.where(self.j + 1 - lead[self.r] < n_nodes[self.r], right, -1)
        self.bucket = h.astype(np.int64).view(np.uint64) * P2 + salt.astype(np.uint64) * P3

    def group(self) -> None:
        """Equal edges get one number; their smallest coordinate, and at how many places they are."""
        key = mixed(self.edge + self.bucket[self.r])
        order = np.argsort(key, kind="stable")
        if not self.ascending(key, order):  # several texts under one id
            order = np.lexsort((self.row, self.pos, self.doc, key))
        new = new_values(key[order])
        self.number = np.empty(len(key), np.int64)
        self.number[order] = np.cumsum(new) - 1
        same = ~new
        same[1:] &= np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (self.doc, self.pos, self.row)]) if len(order) else same[1:]
        self.begin = order[new]
        self.times = np.bincount(self.number[order[~same]], minlength=len(self.begin))

    def ascending(self, key: np.ndarray, order: np.ndarray) -> bool:
        k, d, p = key[order], self.doc[order], self.pos[order]
        return bool(((k[1:] != k[:-1]) | (d[1:] > d[:-1]) | ((d[1:] == d[:-1]) & (p[1:] >= p[:-1]))).all())

    def nonbranching(self) -> np.ndarray:
        """For each node whether just one repeated edge comes in and one goes out, over all its occurrences."""
        key = mixed(self.node.astype(np.uint64) + self.bucket[self.node_row])
        room = max(1, int(len(key)).bit_length())
        packed = key >> np.uint64(room) << np.uint64(room) | np.arange(len(key), dtype=np.uint64)  # fewer bits can only make a node branch
        packed.sort()
        at = (packed & np.uint64((1 << room) - 1)).view(np.int64)
        name = np.empty(len(key), np.int64)
        name[at] = np.cumsum(new_values(packed >> np.uint64(room))) - 1
        good = np.ones(len(key), bool)
        for edge in (self.into, self.out):
            there = edge >= 0
            there[there] = self.times[self.number[edge[there]]] > 1
            pair = np.unique(name[there] << 32 | self.number[edge[there]])
            good &= (np.bincount(pair >> 32, minlength=len(key)) == 1)[name]
        return good

    def pieces(self, later: np.ndarray, from_doc: np.ndarray, from_row: np.ndarray, from_pos: np.ndarray, joins: np.ndarray) -> list[np.ndarray]:
        """doc, row, start, edges, source doc, row, start and whether the first node is nonbranching, of later occurrences.

        All arguments are by edge; ``joins``: whether the node it comes from is nonbranching.
        """
        at = np.flatnonzero(later & self.own)
        apart = np.ones(len(at), bool)
        apart[1:] = (np.diff(at) != 1) | (np.diff(self.r[at]) != 0) | (np.diff(from_pos[at]) != 1) | (from_doc[at[1:]] != from_doc[at[:-1]]) | (from_row[at[1:]] != from_row[at[:-1]]) | ~joins[at[1:]]
        first = np.flatnonzero(apart)
        n, at = np.diff(np.append(first, len(at))), at[first]
        return [self.doc[at], self.row[at], self.pos[at], n, from_doc[at], from_row[at], from_pos[at], joins[at]]


PIECES = "doc long, row long, start long, n long, from_doc long, from_row long, from_start long, joins boolean"
HEADS = "h long, salt int, edge long, times long, doc long, row long, start long, out_of long, into long"
#: What a bucket gives: pieces (kind 0), or where it is salted its edges (1) and its own rows again (2).
GIVEN = "kind int, h long, salt int, doc long, row long, start long, n long, from_doc long, from_row long, from_start long, joins boolean, edge long, times long, out_of long, into long, lead int, edges binary, nodes binary"


def given(kind: int, **columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, kind, np.int32)
    fields = [x.split() for x in GIVEN.split(", ")]
    return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], types[t])) if c in columns else pa.nulls(n, types[t]) for c, t in fields], [c for c, _ in fields])


def solved(rows: pa.Table, salted: bool) -> Iterator[pa.RecordBatch]:
    """``rows``: whole buckets of ``runs``, all of them salted or none."""
    h, salt, _, doc, start, row, lead = (rows.column(i).to_numpy() for i in range(7))
    edges, nodes = (x.chunk(0) if isinstance(x := rows.column(i).combine_chunks(), pa.ChunkedArray) else x for i in (7, 8))
    b = Bucket(h, salt, doc, start, row, lead, edges, nodes)
    b.group()
    if not salted:
        source = b.begin[b.number]
        later = (b.times[b.number] > 1) & ((b.doc != b.doc[source]) | (b.pos != b.pos[source]))
        joins = np.zeros(len(later), bool)
        good, there = b.nonbranching(), b.left >= 0
        joins[there] = good[b.left[there]]
        yield given(0, **dict(zip([x.split()[0] for x in PIECES.split(", ")], b.pieces(later, b.doc[source], b.row[source], b.pos[source], joins), strict=True)))
        return
    ends = []
    for node in (b.left, b.right):
        there = node >= 0
        end = np.full(len(b.begin), -1, np.int64)
        end[b.number[there]] = b.node[node[there]]
        ends.append(pa.array(end, mask=end < 0))
    at = b.begin
    yield given(1, h=b.h[b.r[at]], salt=b.salt[b.r[at]], edge=b.edge[at].view(np.int64), times=b.times, doc=b.doc[at], row=b.row[at], start=b.pos[at], out_of=ends[0], into=ends[1])
    kept = np.flatnonzero(~b.again)
    yield given(2, h=h[kept], salt=salt[kept], doc=doc[kept], row=row[kept], start=start[kept].astype(np.int64), lead=lead[kept], edges=edges.take(pa.array(kept)), nodes=nodes.take(pa.array(kept)))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets whole, many at a time; ``batches``: sorted rows of ``runs``."""
    held, n = [], 0

    def all_of(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        many = whole.column(2).to_numpy() > 1
        for salted in (False, True):
            if (many == salted).any():
                yield from solved(whole.filter(pa.array(many == salted)).combine_chunks(), salted)

    for b in batches:
        held.append(b)
        n += b.column(7).nbytes // 8
        if n < EDGES:
            continue
        whole = pa.Table.from_batches(held)
        h, salt = whole.column(0).to_numpy(), whole.column(1).to_numpy()
        cut = int(np.flatnonzero((h != h[-1]) | (salt != salt[-1]))[-1]) + 1 if ((h != h[-1]) | (salt != salt[-1])).any() else 0
        if cut:
            yield from all_of(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
            n = sum(x.column(7).nbytes // 8 for x in held)
    if held:
        yield from all_of(pa.Table.from_batches(held))


def salted_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of the salted buckets.  ``rows``: kinds 1 and 2."""
    heads = rows.where("kind = 1").select(*[x.split()[0] for x in HEADS.split(", ")])
    source = F.struct("doc", "start", "row")
    whole = heads.groupBy("h", "edge").agg(F.sum("times").alias("times"), F.min(source).alias("source"), F.max("out_of").alias("out_of"), F.max("into").alias("into")).where("times > 1")
    degree = whole.select("h", F.col("out_of").alias("node"), F.lit(1).alias("goes_out"), F.lit(0).alias("comes_in")).unionByName(whole.select("h", F.col("into").alias("node"), F.lit(0).alias("goes_out"), F.lit(1).alias("comes_in")))
    joining = degree.where("node IS NOT NULL").groupBy("h", "node").agg(F.sum("goes_out").alias("o"), F.sum("comes_in").alias("i")).where("o = 1 AND i = 1").select("h", F.col("node").alias("out_of"), F.lit(True).alias("joins"))
    whole = whole.join(joining, ["h", "out_of"], "left").select("h", "edge", "source", F.coalesce("joins", F.lit(False)).alias("joins"))
    back = heads.select("h", "salt", "edge").join(whole, ["h", "edge"]).select(F.col("h").alias("bucket"), F.col("salt").alias("part"), "edge", "source.doc", "source.row", "source.start", "joins")
    own = rows.where("kind = 2").select("h", "salt", "doc", "start", "row", "lead", "edges", "nodes")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in PIECES.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names}).astype({n: "bool" if n == "joins" else "int64" for n in names})
        left = left.sort_values(["doc", "start", "row"], kind="stable")
        b = Bucket(*(left[c].to_numpy() for c in ("h", "salt", "doc", "start", "row", "lead")), *(pa.array(left[c].tolist(), pa.binary()) for c in ("edges", "nodes")))
        right = right.sort_values("edge")
        edge = right["edge"].to_numpy()
        at = np.minimum(np.searchsorted(edge, b.edge.view(np.int64)), len(edge) - 1)
        doc, row, pos, joins = (right[c].to_numpy()[at] for c in ("doc", "row", "start", "joins"))
        later = (edge[at] == b.edge.view(np.int64)) & ((b.doc != doc) | (b.pos != pos))
        return pd.DataFrame(dict(zip(names, b.pieces(later, doc, row, pos, joins & (b.left >= 0)), strict=True)))

    return own.groupBy("h", "salt").cogroup(back.groupBy("bucket", "part")).applyInPandas(run, PIECES)


def spans(pieces: DataFrame) -> DataFrame:
    """(doc, row, start, n, paths, from_doc, from_row, from_start): pieces that meet, with sources that go on, made one.

    ``paths``: over how many paths of the graph a span goes; pieces that meet over a nonbranching node are of one path.
    """
    along = Window.partitionBy("doc", "row").orderBy("start")
    goes_on = F.struct((F.col("start") + F.col("n")).alias("start"), "from_doc", "from_row", (F.col("from_start") + F.col("n")).alias("from_start"))
    meets = F.lag(goes_on).over(along).eqNullSafe(F.struct("start", "from_doc", "from_row", "from_start"))
    numbered = pieces.withColumn("meets", meets).withColumn("span", F.sum(F.when(F.col("meets"), 0).otherwise(1)).over(along))
    new_path = F.when(F.col("meets") & F.col("joins"), 0).otherwise(1)
    first = F.min(F.struct("start", "from_doc", "from_row", "from_start")).alias("first")
    return numbered.groupBy("doc", "row", "span").agg(first, F.sum("n").alias("n"), F.sum(new_path).alias("paths")).select("doc", "row", "first.start", "n", "paths", "first.from_doc", "first.from_row", "first.from_start")


def digests(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(doc, row, start, n, digest) of the words of each asked stretch of ``n`` windows, read from the text."""
    wanted = asked.distinct().groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            held: list[tuple] = []
            for doc, row, text, spans in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                if (doc, row) == before:
                    continue
                before = (doc, row)
                words = words_of(text)
                whole = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                start, n = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
                a, z = np.concatenate([[0], ends])[start].tolist(), (ends[start + n + k - 2] - 1).tolist()
                held += [(doc, row, i, j, hashlib.blake2b(whole[x:y], digest_size=16).digest()) for i, j, x, y in zip(start.tolist(), n.tolist(), a, z, strict=True)]
            if held:
                yield digest_batch(held)

    return docs.select("doc", "row", "text").join(wanted, ["doc", "row"]).select("doc", "row", "text", "asked").mapInArrow(run, "doc long, row long, start long, n long, digest binary").distinct()


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], ["doc", "row", "start", "n", "digest"])


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = ANCHOR, bits: int = 64) -> DataFrame:
    """Verified spans (see ``spans``): stretches of ``n`` windows that stand earlier, and where.  ``docs``: doc, row (hash of the text), key (of both), text.

    ``bits`` of an edge's hash count in the first search, all of them in later ones.
    """
    for seed in range(TRIES):
        marks, total = marked(docs, k, m, seed)
        parts = max(shuffle_partitions(docs.sparkSession), -(-total * ROW_BYTES // PART_BYTES))
        rows = runs(docs.join(marks, "key"), k, m, seed, 64 if seed else bits)
        rows = rows.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "doc", "start", "row")
        solved_ = written(rows.mapInArrow(by_bucket, GIVEN), "buckets")
        dropped(marks)
        pieces = solved_.where("kind = 0").select(*[x.split()[0] for x in PIECES.split(", ")])
        if not solved_.where("kind = 2").isEmpty():
            pieces = pieces.unionByName(salted_pieces(solved_.where("kind > 0")))
        found = written(spans(pieces), "spans")
        dropped(solved_)
        source = found.select(F.col("from_doc").alias("doc"), F.col("from_row").alias("row"), F.col("from_start").alias("start"), "n")
        read = written(digests(docs, found.select("doc", "row", "start", "n").unionByName(source), k), "span-digests")
        of = read.select(F.col("doc").alias("from_doc"), F.col("row").alias("from_row"), F.col("start").alias("from_start"), "n", F.col("digest").alias("there"))
        checked = found.join(read, ["doc", "row", "start", "n"]).join(of, ["from_doc", "from_row", "from_start", "n"])
        checked = written(checked.withColumn("agrees", F.col("digest") == F.col("there")).drop("digest", "there"), "checked-spans")
        dropped(found, read)
        if checked.where("NOT agrees").isEmpty():
            return checked.drop("agrees")
        dropped(checked)
    raise RuntimeError(f"windows with equal hashes and other words in {TRIES} searches")


SPAN = "array<struct<start: bigint, words: bigint, source_doc: bigint, source_start: bigint>>"


def without_repeats(docs: DataFrame, k: int = WINDOW, m: int = ANCHOR, bits: int = 64) -> DataFrame:
    """Adds kept (text), n_words, n_removed and spans to the columns of ``docs``.

    Words are runs of other characters than space and \\x09-\\x0D.  A word goes if a window of k words that
    covers it also starts earlier: in a smaller doc_id, or before in the same document; spans tell where.  kept joins the
    other words by one space; texts that lose nothing keep their white space.  Null texts have no words and stay null.  Rows with a null id come
    before all others and, like other rows with one id, count as one document: of windows at the same place in
    them neither is earlier.  All rows and columns stay, whatever the columns' names; the operator's own are the last five.  ``bits``: see ``repeated_spans``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, plain, columns = numbered_columns(docs)
    own = rows.withColumn("__doc", F.coalesce(columns["doc_id"].cast("long"), F.lit(NO_ID))).withColumn("__row", F.xxhash64(columns["text"])).withColumn("text", columns["text"])
    with clean_shuffles(spark):
        found = repeated_spans(own.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.xxhash64("__doc", "__row").alias("key"), "text"), k, m, bits)
    hit = F.struct("start", (F.col("n") + (k - 1)).alias("words"), "from_doc", "from_start")
    hits = found.groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(hit)).alias("__hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            hits = b.column(1)
            for i, text in enumerate(b.column(0).to_pylist()):
                words = words_of(text)
                gone, spans = 0, []
                if hits[i].is_valid:
                    spans = np.stack([hits[i].values.field(j).to_numpy() for j in range(4)], 1).tolist()
                    change = np.zeros(len(words) + 1, np.int64)
                    for s, size, *_ in spans:
                        change[s] += 1
                        change[s + size] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    gone = int(covered.sum())
                    text = b" ".join([words[j] for j in np.flatnonzero(~covered).tolist()]).decode()
                out.append((text, len(words), gone, hashlib.sha256(b" ".join(words) if not gone else text.encode()).hexdigest(), [dict(zip(("start", "words", "source_doc", "source_start"), s, strict=True)) for s in spans]))
            kept, n, gone, sha, spans = zip(*out, strict=True) if out else [[]] * 5
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "words", "source_doc", "source_start")]))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)], [*b.schema.names[2:], "kept", "n_words", "n_removed", "kept_sha256", "spans"])

    joined = own.join(hits, ["__doc", "__row"], "left").select("text", "__hits", *plain)
    added = StructType.fromDDL(f"kept string, n_words long, n_removed long, kept_sha256 string, spans {SPAN}")
    done = joined.mapInArrow(run, with_added(rows, plain, added))
    return done.select(*with_names(columns, added.names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))


_NEXT = ", ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, WINDOW))])

SQL = f"""
WITH lists AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM lists),
windows AS (SELECT doc_id, pos, md5(concat_ws(' ', {_NEXT})) AS k FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos) QUALIFY pos <= n - {WINDOW - 1}),
edges AS (SELECT doc_id, pos, first_value(doc_id) OVER e AS src, first_value(pos) OVER e AS src_pos, row_number() OVER e > 1 AS later FROM windows WINDOW e AS (PARTITION BY k ORDER BY doc_id, pos)),
marked AS (
  SELECT w.doc_id, w.w, w.pos, coalesce(e.later, false) AS later,
         coalesce(e.later, false) AND NOT coalesce(lag(e.later) OVER o AND lag(e.src) OVER o = e.src AND lag(e.src_pos) OVER o = e.src_pos - 1, false) AS opens
  FROM words w LEFT JOIN edges e USING (doc_id, pos) WINDOW o AS (PARTITION BY w.doc_id ORDER BY w.pos)),
covered AS (SELECT *, max(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
found AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept, count(*) FILTER (opens) AS n_spans FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans
FROM lists LEFT JOIN found USING (doc_id)
"""
