"""Token ids in files compressed by Re-Pair grammars.

Documents go to shards in ascending doc_id order (range partitions, sorted).  A shard is cut into blocks of
about ``BLOCK`` ids; each block has its own grammar.  Pairs of neighbouring symbols, never across two documents, are
counted exactly; the most frequent ones become nonterminals and their occurrences are replaced, until no pair
occurs ``FREQUENT`` times or more in the block.  A block stores its rules, the number of ids to which each
nonterminal expands, its symbols, and each document's symbol and id counts: a document, or a stretch of it, is decoded
from its own symbols alone.  A file ends with the places of its blocks and their first and last doc_ids, so a
document is read by seeking one block.

File layout (little-endian): blocks one after the other, the footer, a tail.  Block: magic ``RPR2``, then unsigned 32-bit
numbers documents, rules, symbols, width (2 or 4, bytes of a symbol), alphabet (symbols below it are ids
of ``literals``), then literals (u32 each), rules (two u32 symbols each), expansion lengths (u32 each), symbols
(``width`` each), symbols and ids of each document (u32 each), doc_ids (i64 each).  Footer: for each block offset, bytes,
documents and ids (u64 each), first and last doc_id (i64 each).  Tail: number of blocks (u32), magic.  A null id is
stored as the smallest long, and such an id is read as null.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, small_batches, table, written
from .tokens import BYTE_BPE, tokens

END_ID = 2
BLOCK = 1 << 20
#: The fewest occurrences that make a pair frequent.
FREQUENT = 8
#: A round replaces the pairs that occur at least one n-th as often as the most frequent one.
BAND = 8
#: Bytes of texts that are encoded at a time, about.
TOGETHER = 16 << 20
MAGIC = b"RPR2"
HEAD, ENTRY, TAIL = struct.Struct("<4s5I"), struct.Struct("<4Q2q"), struct.Struct("<I4s")


def frequent(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequent pairs, their occurrences, and for each of ``pairs`` its number among them from 1, or 0).  ``bits``: of a pair."""
    n = len(pairs)
    room = max(1, int(n - 1).bit_length()) if n else 1
    if bits + room <= 64:  # places sort with their pairs
        packed = pairs << np.uint64(room)
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        at = (packed & np.uint64((1 << room) - 1)).view(np.int64)
        packed >>= np.uint64(room)
    else:
        at = np.argsort(pairs, kind="stable")
        packed = pairs[at]
    begin = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), packed[1:] != packed[:-1]]))
    count = np.diff(begin, append=n)
    good = count >= FREQUENT
    number = np.zeros(n, np.int32)
    number[at[np.repeat(good, count)]] = np.repeat(np.arange(1, int(good.sum()) + 1, dtype=np.int32), count[good])
    return packed[begin[good]], count[good], number


def compress(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(literals, rules, expansion lengths, symbols, symbols of each document).

    ``sizes``: ids of each document, none zero.  A rule's symbols come before its own number.  Pairs that are not
    frequent when they first occur never become so, since each new pair has a new symbol in it.
    """
    if len(ids) and int(ids.max()) < 1 << 22:
        literals = np.flatnonzero(np.bincount(ids)).astype(np.uint32)
        number = np.zeros(int(literals[-1]) + 1, np.uint32)
        number[literals] = np.arange(len(literals))
        s = number[ids]
    else:
        literals, s = np.unique(ids, return_inverse=True)
        s = s.astype(np.uint32)
    half = FREQUENT // 2  # a rule replaces so many occurrences at least
    bits = max(1, (len(literals) + len(ids) // half).bit_length())
    shift, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    ends = np.cumsum(sizes)  # of the documents
    inner = np.ones(len(s), bool)
    inner[ends - 1] = False
    inside = np.flatnonzero(inner)
    pairs, count, number = frequent(s[inside].astype(np.uint64) << shift | s[inside + 1], 2 * bits)
    own = np.zeros(len(s), np.intp)  # number of the frequent pair that begins at a place, or 0
    own[inside] = number
    pairs, count = np.concatenate([np.zeros(1, np.uint64), pairs]), np.concatenate([[0], count])
    rules, n = [], len(literals)
    while (most := int(count.max())) >= FREQUENT:
        chosen = count >= max(FREQUENT, -(-most // BAND))
        at = np.flatnonzero(chosen.take(own))
        # of overlapping occurrences every second one of a run is replaced: half of all at least, so some pair always reaches ``half``
        begin = np.ones(len(at), bool)
        np.not_equal(np.diff(at), 1, out=begin[1:])
        order = np.arange(len(at))
        at = at[(order - np.maximum.accumulate(np.where(begin, order, 0))) & 1 == 0]
        hits = np.bincount(own[at], minlength=len(pairs))
        kept = np.flatnonzero(hits >= half)
        rule = np.zeros(len(pairs), np.uint32)
        rule[kept] = np.arange(n, n + len(kept))
        new = rule[own[at]]
        at, new = at[new > 0], new[new > 0]
        rules.append(np.stack([pairs[kept] >> shift, pairs[kept] & low], 1).astype(np.uint32))
        n += len(kept)
        alone = at > 0  # the place before is not replaced itself
        alone[1:] &= np.diff(at) != 2
        count -= np.bincount(own[np.concatenate([at, at + 1, at[alone] - 1])], minlength=len(count))  # pairs that end
        s[at] = new
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        s, own = s.take(keep), own.take(keep)
        ends -= np.searchsorted(at + 1, ends)
        at -= np.arange(len(at))
        places = np.concatenate([at, at[alone] - 1])
        own[places] = 0
        inner = np.ones(len(s), bool)
        inner[ends - 1] = False
        places = places[inner[places]]
        more, times, number = frequent(s[places].astype(np.uint64) << shift | s[places + 1], 2 * bits)
        number[number > 0] += len(pairs) - 1
        own[places] = number
        pairs, count = np.concatenate([pairs, more]), np.concatenate([count, times])
        count[0] = 0
    length = np.ones(n, np.int64)
    at = len(literals)
    for part in rules:
        length[at : at + len(part)] = length[part[:, 0]] + length[part[:, 1]]
        at += len(part)
    return literals, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), length[len(literals) :], s, np.diff(ends, prepend=0)


def block_bytes(doc_ids: list[int], ids: list[bytes]) -> bytes:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    literals, rules, lengths, symbols, counts = compress(np.frombuffer(b"".join(ids), "<u4"), sizes)
    width = 2 if len(literals) + len(rules) <= 1 << 16 else 4
    head = HEAD.pack(MAGIC, len(sizes), len(rules), len(symbols), width, len(literals))
    return head + b"".join(x.tobytes() for x in (literals.astype("<u4"), rules.astype("<u4"), lengths.astype("<u4"), symbols.astype(f"<u{width}"), counts.astype("<u4"), sizes.astype("<u4"), np.array(doc_ids, "<i8")))


class Block:
    """Decodes documents of one block, any of them on its own."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols, width, literals = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of a token file")
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            if at > len(data):
                raise EOFError("a block of a token file ends early")
            return np.frombuffer(data, kind, n, at - n * np.dtype(kind).itemsize)

        self.literals, self.rules, lengths = take(literals, "<u4"), take(2 * rules, "<u4").reshape(-1, 2), take(rules, "<u4")
        self.symbols, counts, self.sizes, self.doc_ids = take(symbols, f"<u{width}"), take(docs, "<u4"), take(docs, "<u4"), take(docs, "<i8")
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.length = np.concatenate([np.ones(literals, np.int64), lengths.astype(np.int64)])

    def part(self, i: int, start: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` ids (or all) of document i from ``start`` on; nonterminals that lie outside are never expanded."""
        s = self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]].astype(np.int64)
        total = int(self.length[s].sum())
        if total != self.sizes[i]:
            raise ValueError(f"document {self.doc_ids[i]}: {total} ids, {self.sizes[i]} expected")
        end = total if n is None else min(total, start + n)
        while True:
            upto = np.cumsum(self.length[s])
            own = slice(int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, end)) + 1)
            ahead = int(upto[own.start - 1]) if own.start else 0
            s, start, end = s[own], start - ahead, end - ahead
            deep = s >= len(self.literals)
            if not deep.any() or start >= end:
                return self.literals[s[start:end]]
            at = np.cumsum(1 + deep) - 1  # where a symbol, or the second of a rule, goes
            out = np.empty(int(at[-1]) + 1, np.int64)
            out[at[~deep]] = s[~deep]
            out[at[deep] - 1], out[at[deep]] = self.rules[s[deep] - len(self.literals)].T
            s = out

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document; nonterminals are expanded once for the block."""
        start = np.cumsum(self.length) - self.length
        expanded = np.empty(int(self.length.sum()), np.uint32)
        expanded[: len(self.literals)] = self.literals
        begin, length = start.tolist(), self.length.tolist()
        for i, (a, b) in enumerate(self.rules.tolist(), len(self.literals)):
            at, mid = begin[i], begin[i] + length[a]
            expanded[at:mid] = expanded[begin[a] : begin[a] + length[a]]
            expanded[mid : mid + length[b]] = expanded[begin[b] : begin[b] + length[b]]
        for i, (a, b) in enumerate(zip([0, *self.ends.tolist()], self.ends.tolist(), strict=False)):
            s = self.symbols[a:b]
            n = self.length[s]
            total = int(n.sum())
            if total != self.sizes[i]:
                raise ValueError(f"document {self.doc_ids[i]}: {total} ids, {self.sizes[i]} expected")
            yield expanded[np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(total)]


def footer_of(places: list[tuple]) -> bytes:
    """``places``: ENTRY of each block."""
    return b"".join(ENTRY.pack(*x) for x in places) + TAIL.pack(len(places), MAGIC)


def block_places(file) -> list[tuple]:
    """ENTRY of each block, from the end of an open file."""
    size = file.size()
    blocks, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size)) if size >= TAIL.size else (0, b"")
    if magic != MAGIC:
        raise ValueError("not a token file, or one that ends early")
    return list(ENTRY.iter_unpack(file.read_at(ENTRY.size * blocks, size - TAIL.size - ENTRY.size * blocks)))


def read_document(manifest: DataFrame, doc_id: int, start: int = 0, n: int | None = None) -> list[np.ndarray]:
    """The ids of each row with this doc_id, or ``n`` of them from ``start`` on; of each file only blocks that may hold the id are read."""
    out = []
    for row in manifest.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("shard").collect():
        files, name = pafs.FileSystem.from_uri(row["path"])
        with files.open_input_file(name) as file:
            for offset, size, _, _, first, last in block_places(file):
                if first <= doc_id <= last:
                    block = Block(file.read_at(size, offset))
                    out += [block.part(i, start, n) for i in np.flatnonzero(block.doc_ids == doc_id).tolist()]
    return out


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some batches in one, up to ``TOGETHER`` bytes or one batch: of words that recur in them each is then looked up once."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > TOGETHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


MANIFEST = "shard int, path string, docs long, tokens long, bytes long, first_doc long, last_doc long"
NO_ID = -(1 << 63)


def write_files(docs: DataFrame, path: str = BYTE_BPE, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the token files; gives their manifest, a small table (one row for each file).

    Documents are in ascending doc_id order within and across shards, null ids first, equal ids by text.  Null texts are empty.
    Each attempt of a task writes a file of its own name; only files in the manifest count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "token-files")
    shards = shards or max(shuffle_partitions(spark), 1)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, files, out, name = tokens(path, True), None, None, None
        ids_held: list[bytes] = []
        docs_held: list[int] = []
        places: list[tuple] = []
        held = n_bytes = shard = 0

        def flush():
            nonlocal held, n_bytes
            if docs_held:
                data = block_bytes(docs_held, ids_held)
                out.write(data)
                places.append((n_bytes, len(data), len(docs_held), held, docs_held[0], docs_held[-1]))
                n_bytes += len(data)
                docs_held.clear()
                ids_held.clear()
                held = 0

        for b in together(batches):
            if out is None:
                shard = b.column(2)[0].as_py()
                files, root = pafs.FileSystem.from_uri(folder)
                files.create_dir(root, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rpr"
                out = files.open_output_stream(f"{root}/{name}")
            for doc, ids in zip(b.column(0).to_pylist(), own.encode(["" if t is None else t for t in b.column(1).to_pylist()]), strict=True):
                ids_held.append(ids + end)
                docs_held.append(NO_ID if doc is None else doc)
                held += len(ids) // 4 + 1
                if held >= BLOCK:
                    flush()
        if out is not None:
            flush()
            footer = footer_of(places)
            out.write(footer)
            out.close()
            row = (shard, f"{folder}/{name}", sum(x[2] for x in places), sum(x[3] for x in places), n_bytes + len(footer), places[0][4], places[-1][5])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 0 else pa.string() if i == 1 else pa.int64()) for i, x in enumerate(row)], ["shard", "path", "docs", "tokens", "bytes", "first_doc", "last_doc"])

    sorted_ = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(sorted_.withColumn("shard", F.spark_partition_id()).mapInArrow(run, MANIFEST), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each file
    files = manifest.withColumn("ahead", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).select("path", "ahead")
    files = files.repartition(max(shuffle_partitions(spark), 1), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_file(name) as file:
                    for offset, size, *_ in block_places(file):
                        block = Block(file.read_at(size, offset))
                        crc = [zlib.crc32(x) for x in block.documents()]
                        sizes = block.sizes.astype(np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        doc_ids = pa.array(block.doc_ids, mask=block.doc_ids == NO_ID)
                        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents")))
