"""Media payloads in archives: written as 8-bit WAV members, read back by a Spark data source.

An archive is a zip file, each member deflated on its own; its central directory at the end lists members with their offsets.
The data source ``media_archive`` plans partitions as byte ranges of archives from their sizes alone.  A
partition reads the archive's directory, takes the members whose headers begin in its range, and streams
their payloads as Arrow batches of bounded size.  A member that fails is read again by itself, from its
own offset; what was read before it is not repeated.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, small_batches, table, written

UNIT = 64
RATE = 8000
#: Archives end at about so many bytes; partitions cover so many; batches hold so many.
ARCHIVE, RANGE, BATCH = 128 << 20, 32 << 20, 8 << 20
TRIES = 3
LEVEL = 1


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_media(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Whole-number features of the samples: mean and mean square (in thousandths), peak, crossings of the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum()) * 1000 // len(x)};peak={int(np.abs(x).max())};crossings={crossings}"


def write_archives(docs: DataFrame) -> DataFrame:
    """Writes each row's text as a member; gives the table of archives (path, bytes, members).

    A member's name is a number, its comment carries doc_id and the unpadded length.  Null texts are empty ones, null ids
    stay null, repeated rows are members each.  Each attempt of a task writes files of its own; only those in the table count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        archive = sink = path = None
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal archive
            archive.close()
            sink.close()
            archive = None
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([files.get_file_info(f"{root}/{path}").size]), pa.array([n])], ["path", "bytes", "members"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if archive is None:
                    path, n = f"{uuid.uuid4().hex}.zip", 0
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/{path}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL)
                data = (text or "").encode()
                info = zipfile.ZipInfo(f"{n:08d}.wav", (1980, 1, 1, 0, 0, 0))
                info.comment = json.dumps([doc, len(data)]).encode()
                archive.writestr(info, to_media(padded(data)), zipfile.ZIP_DEFLATED, LEVEL)
                n += 1
                if sink.tell() > ARCHIVE:
                    yield close()
        if archive is not None:
            yield close()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "path string, bytes long, members long"), "archives")


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


LOCAL_HEADER = struct.Struct("<4s5H3I2H")


def member_at(file, info: zipfile.ZipInfo) -> bytes:
    """One member's bytes, found by its offset alone and checked by its CRC."""
    file.seek(info.header_offset)
    head = LOCAL_HEADER.unpack(file.read(LOCAL_HEADER.size))
    if head[0] != b"PK\3\4" or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise OSError(f"no member at {info.header_offset}")
    file.seek(info.header_offset + LOCAL_HEADER.size + head[9] + head[10])
    data = file.read(info.compress_size)
    if info.compress_type == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompress(data, -zlib.MAX_WBITS, info.file_size or 1)
        except zlib.error as e:
            raise OSError(f"member at {info.header_offset} is damaged") from e
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"member at {info.header_offset} is damaged")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.archives = json.loads(options["archives"])
        self.range, self.batch = int(options.get("range", RANGE)), int(options.get("batch", BATCH))

    def partitions(self) -> list[InputPartition]:
        found = [ByteRange(path, at, min(size, at + self.range)) for path, size in self.archives for at in range(0, size, self.range)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, name = pafs.FileSystem.from_uri(partition.path)
        rows, held = [], 0
        with files.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
            infos = sorted((i for i in archive.infolist() if partition.begin <= i.header_offset < partition.end), key=lambda i: i.header_offset)
            for info in infos:
                for attempt in range(TRIES):
                    try:
                        if attempt:  # by a handle of its own
                            with files.open_input_file(name) as again:
                                media = member_at(again, info)
                        else:
                            media = member_at(file, info)
                        break
                    except OSError:
                        if attempt == TRIES - 1:
                            raise
                        time.sleep(0.2 * 2**attempt)
                doc, n = json.loads(info.comment)
                rows.append((doc, n, media))
                held += len(media)
                if held >= self.batch:
                    yield self.arrow(rows)
                    rows, held = [], 0
        if rows:
            yield self.arrow(rows)

    @staticmethod
    def arrow(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """Options: ``archives``, a JSON list of [path, size]; ``range`` and ``batch`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(archives: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every member.  The driver holds paths and sizes, as for any file source."""
    spark = archives.sparkSession
    spark.dataSource.register(ArchiveSource)
    listed = [[r[0], r[1]] for r in archives.select("path", "bytes").collect()]
    return spark.read.format("media_archive").option("archives", json.dumps(listed)).load()


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """Digests and features of each payload, from its media bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, stored in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = from_media(stored)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if rows:
                names = [x.split()[0] for x in OUT.split(", ")]
                kinds = [pa.string() if x.endswith("string") else pa.int64() for x in OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(read_archives(write_archives(table(spark, sf_dir, "documents"))))
