"""One file written by many tasks, each at its own places: the data source ``file_parts``.

The driver makes the file beside its final place, as large as it will be; tasks open it and write their bytes at given offsets.  A repeated task writes the same bytes again.
When all have ended and together wrote what was expected, the file moves to its place; else it is deleted.  The folder has to be one that all machines see.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestone.session import ship


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.beside, self.path, self.expected = options["beside"], options["path"], int(options["expected"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        with open(self.beside, "r+b") as f:
            for b in iterator:
                for i in range(b.num_rows):
                    data = b.column(1)[i].as_buffer()
                    f.seek(b.column(0)[i].as_py())
                    f.write(data)
                    n += data.size
            f.flush()
            os.fsync(f.fileno())
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        found = sum(m.bytes for m in messages if m is not None)
        if found != self.expected:
            os.unlink(self.beside)
            raise ValueError(f"{found} bytes were written of {self.path}, {self.expected} are expected")
        os.replace(self.beside, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.beside):
            os.unlink(self.beside)


class FileParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return "offset long, data binary"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options)


def write_parts(rows: DataFrame, path: str, size: int, fixed: dict[int, bytes]) -> None:
    """``rows``: offset, data (apart from each other); ``fixed``: small parts that the driver writes, by offset.  All must make up ``size`` bytes."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(FileParts)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    beside = os.path.join(folder, f".tmp-{uuid.uuid4().hex}")
    try:
        with open(beside, "wb") as f:
            f.truncate(size)
            for offset, data in fixed.items():
                f.seek(offset)
                f.write(data)
        options = {"path": os.path.abspath(path), "beside": beside, "expected": str(size - sum(map(len, fixed.values())))}
        rows.select("offset", "data").write.format("file_parts").options(**options).mode("append").save()
    finally:
        if os.path.exists(beside):
            os.unlink(beside)
