"""From a directory tree to an index, and from a text to its nearest chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embedding import Embedder, Hashing, cached, embedded
from lodestone.operators import incremental, routed
from lodestone.operators.chunking import Settings, chunked, exploded
from lodestone.operators.knn import knn
from lodestone.sources import extract, scan, store

from .config import IndexConfig


@dataclass
class Ingested:
    log: DataFrame  # every file and refused directory
    extractions: DataFrame  # accepted files, read or failed
    units: DataFrame  # units with their chunks; a failed file is one row without any
    chunks: DataFrame

    def documents(self) -> DataFrame:
        """A row for each accepted file, those that failed too: source_file, success, error_message, units, chunks, words, tokens."""
        c = F.col("chunks")
        total = lambda name: F.sum(F.aggregate(c[name], F.lit(0), lambda a, x: a + x))
        rows = self.units.groupBy("source_file").agg(
            F.bool_and("success").alias("read"), F.max("error_message").alias("error_message"), F.count("source_chunk_index").alias("units"),
            F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"), F.coalesce(total("word_count"), F.lit(0)).alias("words"), F.coalesce(total("token_count"), F.lit(0)).alias("tokens"),
        )
        empty = F.col("read") & (F.col("chunks") == 0)
        return rows.select("source_file", (F.col("read") & ~empty).alias("success"), F.when(empty, F.lit("no chunks")).otherwise(F.col("error_message")).alias("error_message"), "units", "chunks", "words", "tokens")


def ingest(spark: SparkSession, root: str, settings: Settings = Settings(), **scan_options) -> Ingested:
    """Lazy: nothing is read until a part is used."""
    log = scan.scan(spark, root, **scan_options)
    extractions = extract.extracted(scan.files(log))
    units = chunked(extract.unit_rows(extractions, failed=True), settings).drop("text")
    chunks = exploded(units.where("success").drop("success", "error_message"), ["source_file"], "source_chunk_index").withColumnRenamed("chunk_text", "text")
    return Ingested(log, extractions, units, chunks)


#: Rows of search results that are broadcast, at most.
MOST_SENT = 1 << 17
COLUMNS = ("chunk_id", "text", "source_file", "source_label", "format_category", "word_count", "token_count", "source_chunk_index", "chunk_index", "vector")


def changes(old: DataFrame, touched: DataFrame, chunks: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(Chunks to embed and add, with new ids from ``next_id`` on; chunk_ids that go), where some files are read again or gone.

    ``touched``: source_file of these; ``chunks``: all chunks that those read again have now.  A chunk that is the same in all its columns stays as it is.
    """
    key = incremental.KEY
    own = [c for c in COLUMNS if c not in ("chunk_id", "vector")]
    whole = lambda rows: rows.withColumn("__all", F.to_json(F.struct(*[c for c in own if c not in key]), {"ignoreNullFields": "false"}))
    files = touched.select(F.col("source_file").alias("__file")).distinct()
    before = old.drop("vector").join(files, F.col("source_file").eqNullSafe(F.col("__file")), "left_semi")
    merged = incremental.merge(whole(before), whole(chunks.select(*own)), key, "__all", start=next_id).drop("__all")
    kept = merged.where(F.col("chunk_id") < next_id).select(F.col("chunk_id").alias("__kept"))
    return merged.where(F.col("chunk_id") >= next_id), before.join(kept, F.col("chunk_id") == F.col("__kept"), "left_anti").select("chunk_id")


def index(spark: SparkSession, root: str, folder: str, config: IndexConfig | None = None, settings: Settings = Settings(), make: Callable[[], Embedder] | None = None, full: bool = False, graph: bool = True, **scan_options) -> dict:
    """Builds the index, or brings it up to date.

    Only files that the ledger doesn't know with their size and time of change are opened, unless ``settings`` are others than before; only added and changed chunks are embedded, removed ones go.
    Files that couldn't be read are in the ledger too and are tried again when they change, or with ``full``.
    """
    base = store.current(folder)
    old = None if full else base
    config = store.config_of(old) if old else config or IndexConfig()
    make = make or Hashing(config.dim, config.seed)
    said = asdict(settings)
    log = scan.scan(spark, root, **scan_options)
    columns = ("relative_path", "size_bytes", "modified_ts", "absolute_path", "extension", "format_category")
    with store.staged(scan.files(log).select(*columns), folder) as files:
        ledger = store.ledger_of(spark, folder, old) if old and old["settings"] == said else spark.createDataFrame([], store.LEDGER)
        known = ledger.select(F.col("relative_path").alias("__path"), F.col("size_bytes").alias("__size"), F.col("modified_ts").alias("__time"))
        same = (F.col("relative_path") == F.col("__path")) & (F.col("size_bytes") == F.col("__size")) & (F.col("modified_ts") == F.col("__time"))
        changed = files.join(known, same, "left_anti")
        with store.staged(extract.extracted(changed), folder) as read:
            told = read.select(F.col("relative_path").alias("__read"), "file_hash_md5", "success", "error_message")
            rows = changed.join(told, F.col("relative_path") == F.col("__read")).select(*[c.split()[0] for c in store.LEDGER.split(", ")])
            with store.staged(chunks_of(read, settings), folder) as chunks:
                if not old:
                    if chunks.isEmpty():
                        raise ValueError(f"no text was found in {root}")
                    vectors = embedded(incremental.numbered(chunks, ["source_file", "chunk_index"]), make, config.dim)
                    return store.save(vectors.select(*COLUMNS), folder, config, graph, base, rows, said)
                stay = ledger.join(files.select(*[F.col(c).alias(f"__{c}") for c in columns[:3]]), [F.col(c) == F.col(f"__{c}") for c in columns[:3]], "left_semi")
                table = store.table_of(spark, folder, old)
                lost = table.select("source_file").distinct().join(stay.select("relative_path"), F.col("source_file") == F.col("relative_path"), "left_anti")
                fresh, dead = changes(table, lost, chunks, old["next_id"])
                same_files = rows.isEmpty() and stay.count() == ledger.count()
                return store.extended(spark, folder, old, embedded(fresh, make, config.dim).select(*COLUMNS), dead, None if same_files else stay.unionByName(rows), said)


def take(spark: SparkSession, files: DataFrame, folder: str, config: IndexConfig, settings: Settings, make: Callable[[], Embedder]) -> None:
    """Brings an index up to date with some files, whatever others there are; those that the ledger knows as they are are not opened.  ``files``: a written table of accepted files."""
    base, said = store.current(folder), asdict(settings)
    ledger = store.ledger_of(spark, folder, base) if base else spark.createDataFrame([], store.LEDGER)
    known = ledger.select(F.col("relative_path").alias("__path"), F.col("size_bytes").alias("__size"), F.col("modified_ts").alias("__time"))
    changed = files.join(known, (F.col("relative_path") == F.col("__path")) & (F.col("size_bytes") == F.col("__size")) & (F.col("modified_ts") == F.col("__time")), "left_anti")
    with store.staged(extract.extracted(changed), folder) as read:
        told = read.select(F.col("relative_path").alias("__read"), "file_hash_md5", "success", "error_message")
        rows = changed.join(told, F.col("relative_path") == F.col("__read")).select(*[c.split()[0] for c in store.LEDGER.split(", ")])
        with store.staged(chunks_of(read, settings), folder) as chunks:
            if not base:
                vectors = embedded(incremental.numbered(chunks, ["source_file", "chunk_index"]), make, config.dim)
                store.save(vectors.select(*COLUMNS), folder, config, True, None, rows, said)
            elif not rows.isEmpty():
                own = rows.select(F.col("relative_path").alias("source_file"))
                stay = ledger.join(own, F.col("relative_path") == F.col("source_file"), "left_anti")
                fresh, dead = changes(store.table_of(spark, folder, base), own, chunks, base["next_id"])
                store.extended(spark, folder, base, embedded(fresh, make, config.dim).select(*COLUMNS), dead, stay.unionByName(rows), said)


def chunks_of(extractions: DataFrame, settings: Settings) -> DataFrame:
    return exploded(chunked(extract.unit_rows(extractions), settings).drop("text"), ["source_file"], "source_chunk_index").withColumnRenamed("chunk_text", "text")


def search(spark: SparkSession, folder: str, text: str | list[str], k: int = 5, make: Callable[[], Embedder] | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, score, text, source_file, source_label; score is the similarity (or minus the distance for l2)."""
    vectors, graph, config = store.load(spark, folder)
    texts = [text] if isinstance(text, str) else text
    q = cached(make or Hashing(config.dim, config.seed)).encode(texts)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, query array<float>")
    if exact or graph is None:
        found = knn(vectors, queries, k, config.space, "chunk_id", "vector")
    else:
        found = routed.search(graph, queries, k).withColumnRenamed("id", "chunk_id")
    score = 1 - F.col("distance") if config.space == "cosine" else -F.col("distance")
    # at most k rows for each query text; only where these are few are they sent to all tasks
    found = F.broadcast(found) if k * len(texts) <= MOST_SENT else found
    return vectors.join(found, "chunk_id").select("query_id", "rank", "chunk_id", score.alias("score"), "text", "source_file", "source_label").orderBy("query_id", "rank")
