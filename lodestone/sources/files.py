"""Small files and folders in any file system that Spark knows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def hadoop(path: str):
    """(JVM, Hadoop path, its file system) of a path with a scheme, by the active session; None for plain paths."""
    if "://" not in path:
        return None
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def small_file(path: str) -> bytes:
    """The bytes of a small file."""
    if not (found := hadoop(path)):
        with open(path, "rb") as f:
            return f.read()
    jvm, at, fs = found
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def replaced(path: str, put: Callable) -> None:
    """Writes beside ``path``, syncs, and moves it there as a whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".new-")
    try:
        with os.fdopen(handle, "wb") as f:
            put(f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def put_small_file(path: str, data: bytes) -> None:
    """Writes beside ``path`` and moves it there as a whole."""
    if not (found := hadoop(path)):
        replaced(path, lambda f: f.write(data))
        return
    jvm, at, fs = found
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    over = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), fs.getConf()).rename(beside, at, over)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all in it; nothing if it isn't there."""
    at, fs = _at(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below one."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all below a folder."""
    at, fs = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def put_new_file(path: str, data: bytes) -> bool:
    """Writes a file as a whole if there is none under its name; tells whether it did.  Of several writers one does."""
    if not (found := hadoop(path)):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        replaced(beside, lambda f: f.write(data))
        try:
            os.link(beside, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
        return True
    jvm, at, fs = found
    if fs.exists(at):
        return False
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    plain = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), fs.getConf()).rename(beside, at, plain)
    except Exception as e:
        fs.delete(beside, False)
        if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
            return False
        raise
    return True
