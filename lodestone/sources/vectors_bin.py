"""The binary vector file: unsigned 32-bit n and dim, then n x dim 32-bit floats, little-endian.

``vectors_bin`` is a Spark data source: row ranges are partitions, and a row's position is its chunk_id.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.incremental import numbered
from lodestone.session import ship

from .files import replaced
from .parts import write_parts
from .pushed import Condition, Wanted, said

HEADER = struct.Struct("<II")
ROWS = 1 << 16
BATCH = 4096
#: Bytes that a task writes, about.
PART = 32 << 20


def header(path: str, dim: int | None = None, strict: bool = True) -> tuple[int, int]:
    """(n, dim).  Errors: too short a file, another dim, and in strict mode bytes after the last row."""
    size = os.path.getsize(path)
    if size < HEADER.size:
        raise ValueError(f"{path} has no header")
    with open(path, "rb") as f:
        n, found = HEADER.unpack(f.read(HEADER.size))
    if dim is not None and found != dim:
        raise ValueError(f"{path} has {found} components, {dim} are expected")
    need = HEADER.size + 4 * n * found
    if size < need:
        raise ValueError(f"{path} is cut off: {size} of {need} bytes")
    if strict and size > need:
        raise ValueError(f"{path} has {size - need} bytes after its last row")
    return n, found


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("strict", "true").lower() == "true"
        self.expected = int(options["dim"]) if "dim" in options else None
        self.wanted = Wanted(options.get("wanted"), ["chunk_id"])

    def partitions(self) -> list[InputPartition]:
        n, _ = header(self.path, self.expected, False)
        of, ids = self.wanted.of, [i for v in self.wanted.of("chunk_id", "in") for i in (min(v, default=n), max(v, default=-1))]
        least = max([0, *of("chunk_id", ">=", "="), *(v + 1 for v in of("chunk_id", ">")), *ids[::2]])
        end = min([n, *of("chunk_id", "<"), *(v + 1 for v in of("chunk_id", "<=", "=")), *(v + 1 for v in ids[1::2])])
        return [Rows(a, min(end, a + ROWS)) for a in range(least, end, ROWS)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        _, dim = header(self.path, self.expected, False)
        with open(self.path, "rb") as f:
            f.seek(HEADER.size + 4 * dim * partition.begin)
            for at in range(partition.begin, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                flat = np.frombuffer(f.read(4 * n * dim), "<f4")
                if self.strict and not np.isfinite(flat).all():
                    raise ValueError(f"{self.path} has a vector that is not finite")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(flat))
                batch = pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], ["chunk_id", "vector"])
                if self.wanted.of("chunk_id", "in"):
                    batch = batch.filter(pa.array([self.wanted.fits("chunk_id", i) for i in range(at, at + n)]))
                yield batch


class VectorsBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors_bin"

    def schema(self) -> str:
        return "chunk_id long, vector array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)


def read(spark: SparkSession, path: str, dim: int | None = None, strict: bool = True, only: Iterable[Condition] = ()) -> DataFrame:
    """chunk_id and vector.  Strict mode refuses bytes after the last row and values that are not finite.  ``only``: conditions on chunk_id, see ``pushed``; rows before the least and after the largest id wanted are not read."""
    header(path, dim, False)
    ship(spark)
    spark.dataSource.register(VectorsBin)
    options = {"strict": str(strict).lower(), "wanted": said(only)} | ({"dim": str(dim)} if dim else {})
    return spark.read.format("vectors_bin").options(**options).load(path)


def write(vectors: DataFrame, path: str, dim: int | None = None, strict: bool = True, id_col: str = "chunk_id", vector: str = "vector") -> int:
    """Writes rows in the order of their ids; gives their number.  Each task writes its rows at their places in the file.

    Ids from 0 to n - 1 are positions; others are numbered in their order first.  Strict mode refuses an empty table and other lengths than ``dim``.  The file appears as a whole or not at all.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    n, least, most, ids, first = rows.agg(F.count("*"), F.min("id"), F.max("id"), F.countDistinct("id"), F.min_by(F.size("v"), "id")).first()
    if not n:
        if strict:
            raise ValueError("no vectors to write")
        replaced(path, lambda f: f.write(HEADER.pack(0, dim or 0)))
        return 0
    width, before = dim or first, HEADER.size
    if not (least == 0 and most == n - 1 and ids == n):
        rows = numbered(rows.withColumnRenamed("id", "old"), ["old"], 0, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            size = b.column(1).value_lengths().fill_null(-1).to_numpy()
            if (size != width).any():
                at = int(np.flatnonzero(size != width)[0])
                raise ValueError(f"vector {ids[at]} has {max(0, size[at])} components, {width} are expected")
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, width)
            cut = np.flatnonzero(np.diff(ids, prepend=ids[0] - 2) != 1)
            parts = [x[a:z].tobytes() for a, z in zip(cut, [*cut[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(before + 4 * width * ids[cut]), pa.array(parts, pa.binary())], ["offset", "data"])

    size = 4 * n * width
    parts = max(1, -(-size // PART))
    placed = rows.select("id", "v").repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, "offset long, data binary")
    write_parts(placed, path, HEADER.size + size, {0: HEADER.pack(n, width)})
    return n
