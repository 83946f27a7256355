"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.session import ship

#: Documents go to Python in Arrow batches of at most so many rows, and so many bytes where Spark
#: supports a byte bound; either keeps a worker's memory flat when texts are long.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset and all runs on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        if hadoop.isDefined():
            return hadoop.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what operators have written to the shared folder in this process, once results are taken: tables and files made after the first ``since``, but for ``keep``."""
    kept = {f.rpartition("/")[0] for f in keep.inputFiles()} if keep is not None else set()
    for path in _made[since:]:
        if not any(k.endswith(path.partition("://")[2] or path) for k in kept):
            deleted(spark, path)
            _made.remove(path)


def made() -> int:
    return len(_made)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """To be called before Python work on texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_columns(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """``df`` with its columns as c0, c1 and so on, these names, and what each column of ``df`` is now: nothing that an operator adds can clash with them."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names, {c: F.col(n) for c, n in zip(df.columns, names, strict=True)}


def with_added(df: DataFrame, names: list[str], added: StructType) -> StructType:
    """The schema of those columns of ``df`` and of ``added`` behind them."""
    return StructType([StructField(n, df.schema[n].dataType) for n in names] + added.fields)


def with_names(columns: dict[str, Column], added: list[str]) -> list[Column]:
    """The columns under their names, then those of ``added``.  A name may be there twice then: ``toDF`` tells such columns apart."""
    return [c.alias(n) for n, c in columns.items()] + [F.col(a) for a in added]


def carried(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(The needed columns, and all others in one struct that no operator looks into; what makes the columns of ``docs`` of that again).

    The second takes the rows and new values of some columns, by name.
    """
    others = [c for c in docs.columns if c not in needed]
    field = {c: f"c{i}" for i, c in enumerate(others)}
    row = F.struct(*[F.col(f"`{c}`").alias(f) for c, f in field.items()]) if others else F.struct(F.lit(True).alias("none"))
    place = {c: F.col("carried")[f] for c, f in field.items()} | {c: F.col(c) for c in needed}

    def back(rows: DataFrame, new: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
        values = place | new(place) if new else place
        return rows.select(*[values[c].alias(c) for c in docs.columns])

    return docs.select(*needed, row.alias("carried")), back


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when the query that wrote them has ended, where Spark can do that."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing needs any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            deleted(df.sparkSession, folder)
