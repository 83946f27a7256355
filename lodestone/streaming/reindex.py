"""Re-indexing on demand as a Structured Streaming job: what is new since the last run, then it stops.

``reindex`` takes Parquet files of chunks, ``watch`` the files of a directory tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embedding import Embedder, Hashing, embedded
from lodestone.operators import incremental
from lodestone.operators.chunking import Settings
from lodestone.plans import retrieval
from lodestone.plans.config import IndexConfig
from lodestone.sources import scan, store

CHUNKS = "source_file string, source_label string, format_category string, source_chunk_index int, chunk_index int, text string, word_count int, token_count int"


def reindex(spark: SparkSession, incoming: str, folder: str, checkpoint: str, config: IndexConfig, make: Callable[[], Embedder] | None = None, graph: bool = True) -> None:
    """Merges the Parquet chunk files that came into ``incoming``; each file is taken once.

    Chunks of a file that is in the batch replace all it had; other files stay.  Where two files of a batch have one
    chunk, that of the later file counts (by time, then path, then text).  A repeated batch changes nothing.
    """
    make = make or Hashing(config.dim, config.seed)
    key = ["source_file", "source_chunk_index", "chunk_index"]

    def merge(batch: DataFrame, _: int) -> None:
        columns = [c for c in batch.columns if c not in ("__time", "__path")]
        latest = F.max_by(F.struct(*[c for c in columns if c not in key]), F.struct("__time", "__path", "text"))
        batch = batch.groupBy(*key).agg(latest.alias("row")).select(*key, "row.*").select(*columns)
        with store.staged(batch, folder) as rows:
            if rows.isEmpty():
                return
            base = store.current(folder)
            if base:
                fresh, dead = retrieval.changes(store.table_of(spark, folder, base), rows.select("source_file"), rows, base["next_id"])
                store.extended(spark, folder, base, embedded(fresh, make, config.dim).select(*retrieval.COLUMNS), dead)
            else:
                store.save(embedded(incremental.numbered(rows, key), make, config.dim).select(*retrieval.COLUMNS), folder, config, graph)

    stream = spark.readStream.schema(CHUNKS).parquet(incoming).select("*", F.col("_metadata.file_modification_time").alias("__time"), F.col("_metadata.file_path").alias("__path"))
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def watch(spark: SparkSession, root: str, folder: str, checkpoint: str, config: IndexConfig | None = None, settings: Settings = Settings(), make: Callable[[], Embedder] | None = None, every: str | None = None, **scan_options):
    """Takes the files of a tree that came or changed since the last run into the index; gives the query.

    ``every``: how often to look, as in "1 minute"; without it the query ends when all is taken.  Files that are gone stay in the index until ``retrieval.index`` runs.  A repeated batch changes nothing.
    """
    base = store.current(folder)
    config = store.config_of(base) if base else config or IndexConfig()
    make = make or Hashing(config.dim, config.seed)

    def take(batch: DataFrame, _: int) -> None:
        with store.staged(batch, folder) as files:
            if not files.isEmpty():
                retrieval.take(spark, files, folder, config, settings, make)

    writer = scan.stream(spark, root, **scan_options).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
