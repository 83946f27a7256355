"""Metadata records of the exchange form: one JSON array, written and read by many tasks.

The usual form has a record's braces on lines of their own, two spaces in.  A line can't end inside a JSON string, so such a line is a record's
start wherever one begins to read: the data source ``metadata_json`` cuts the file into byte ranges, and a range has the records that start in it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from lodestone.session import ship

from .files import replaced
from .parts import write_parts

#: Bytes of a range to read, and of a block that is written at once, about.
RANGE, BLOCK = 32 << 20, 1 << 20
START, END = b"  {\n", (b"  }\n", b"  },\n", b"  }")
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def usual(path: str) -> bool:
    """Whether the file has the usual form, by how it begins."""
    with open(path, "rb") as f:
        return f.read(2 + len(START)) == b"[\n" + START


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class MetadataReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.size = options["path"], int(options.get("range", RANGE))
        self.fields = [(f.name, {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        n = os.path.getsize(self.path)
        return [Range(a, min(n, a + self.size)) for a in range(0, n, self.size)] or [Range(0, 0)]

    def records(self, partition: Range) -> Iterator[dict]:
        with open(self.path, "rb") as f:
            at = max(0, partition.begin - 1)
            f.seek(at)
            if at:  # to the start of a line, which may be the range's own first byte
                at += len(f.readline())
            record: list[bytes] | None = None
            for line in f:
                if record is None:
                    if at >= partition.end:
                        return
                    if line == START:
                        record = [line]
                elif line in END:
                    yield json.loads(b"".join(record) + b"}")
                    record = None
                else:
                    record.append(line)
                at += len(line)
            if record is not None:
                raise ValueError(f"{self.path} ends inside a record")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], TYPES[t]) for n, t in self.fields], [n for n, _ in self.fields])

        for r in self.records(partition):
            held.append(r)
            if len(held) == 4096:
                yield batch()
                held.clear()
        yield batch()


class MetadataJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metadata_json"

    def schema(self) -> str:
        raise ValueError("metadata_json needs a schema")

    def reader(self, schema) -> MetadataReader:
        return MetadataReader(self.options, schema)


def read(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A row for each record; fields that it lacks are null.  Files of another form than the usual one are read by one task."""
    if not usual(path):
        return spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ship(spark)
    spark.dataSource.register(MetadataJson)
    return spark.read.format("metadata_json").schema(fields).load(path)


def count(path: str) -> int:
    """How many records there are, without parsing them where the file has the usual form."""
    with open(path, "rb") as f:
        if usual(path):
            return sum(line == START for line in f)
        return len(json.load(f))


def write(rows: DataFrame, path: str, names: list[str], id_col: str) -> None:
    """Records in the order of their ids.  They become blocks of text by ranges of ids; blocks' sizes tell where each goes, then tasks write them side by side."""
    spark = rows.sparkSession
    ship(spark)
    folder = os.path.join(os.path.dirname(os.path.abspath(path)), f".staged-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = TaskContext.get().partitionId() << 32, []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                text = (",\n" + "\n".join("  " + x for x in json.dumps(r, indent=2, ensure_ascii=False).split("\n"))).encode()
                held.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b"".join(held)], pa.binary())], ["key", "data"])
                    key, held, size = key + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([b"".join(held)], pa.binary())], ["key", "data"])

    try:
        rows.select(*names).repartitionByRange(id_col).sortWithinPartitions(id_col).mapInArrow(run, "key long, data binary").write.parquet(folder)
        blocks = spark.read.schema("key long, data binary").parquet(folder)
        sizes = blocks.select("key", F.octet_length("data").cast("long").alias("size"))
        total = sizes.agg(F.sum("size")).first()[0]
        if total is None:
            replaced(path, lambda f: f.write(b"[]"))
            return
        # a row for each block of BLOCK bytes
        ahead = F.coalesce(F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = blocks.join(sizes.select("key", ahead.alias("offset")), "key")
        # the first record has the array's bracket for a comma
        data = F.when(F.col("offset") == 0, F.concat(F.lit(b"["), F.substring("data", 2, 1 << 30))).otherwise(F.col("data"))
        write_parts(placed.select("offset", data.alias("data")), path, total + 2, {total: b"\n]"})
    finally:
        shutil.rmtree(folder, ignore_errors=True)
