"""Index folders: a table in segments with a manifest, and the exchange form of three files.

A version of an index is a list of segments (Parquet tables of rows that were added together), tables of dead ids, a graph and a ledger of the files it was
made from.  An update writes what it adds, the ids that it takes out, and a new manifest, so it costs as much as it changes; readers merge.
Once much is dead, or segments are many, all is written anew.  A version is written in full before a manifest names it, so readers see one version or the
other.  Manifests are numbered and each is made by one writer only: a second one that began from the same version gets ``Conflict``.
The latest version and the one before it stay; folders that only older ones name are deleted.
"""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import is_finite
from lodestone.operators import routed
from lodestone.plans.config import IndexConfig

from . import files, metadata, vectors_bin
from .files import put_new_file, put_small_file, replaced, small_file

#: The exchange form's files, and the fields of a metadata record.
VECTORS, METADATA, CONFIG, MANIFEST = "vectors.bin", "metadata.json", "config.json", "manifest.json"
FIELDS = "chunk_id long, text string, source_file string, source_label string, format_category string, word_count int, token_count int, source_chunk_index int"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
MAGIC, VERSION, KIND = "LODE", 3, 2
#: A version with more segments, or with so large a part of its rows dead, is written anew.
SEGMENTS, DEAD = 16, 0.3
LEDGER = "relative_path string, size_bytes long, modified_ts double, file_hash_md5 string, success boolean, error_message string"


class NoIndex(FileNotFoundError):
    pass


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


def number_path(folder: str, number: int) -> str:
    return f"{folder}/versions/{number:012d}.json"


def manifest(folder: str) -> dict:
    """The latest version: what the manifest says, or a later one whose writer didn't come to say so."""
    try:
        found = json.loads(small_file(f"{folder}/{MANIFEST}"))
    except FileNotFoundError:
        found = None
    number = found["number"] if found and "number" in found else 0
    while True:
        try:
            found, number = json.loads(small_file(number_path(folder, number + 1))), number + 1
        except FileNotFoundError:
            break
    if found is None:
        raise NoIndex(f"[ERROR] No index found in {folder}")
    if (found.get("magic"), found.get("version")) != (MAGIC, VERSION):
        raise ValueError(f"{folder} is not an index of version {VERSION}")
    return found


def named(entry: dict) -> set[str]:
    """Folders that a version needs."""
    graph = entry["graph"]
    inside = [] if not graph else [x for n in ("base", "places") for x in graph["entry"][n]] + [graph["entry"]["centroids"], *(name for _, name in graph["entry"]["deltas"])]
    return {*entry["segments"], *entry["dead"], *filter(None, [entry["files"]]), *(f"{graph['folder']}/{x.split('/')[0]}" for x in inside)}


def committed(spark: SparkSession, folder: str, base: dict | None, entry: dict) -> dict:
    """Makes ``entry`` the next version after ``base``, then deletes what only the version before ``base`` needed."""
    number = base["number"] + 1 if base else 1
    entry = entry | {"magic": MAGIC, "version": VERSION, "kind": KIND, "number": number, "written": time.time()}
    data = json.dumps(entry, indent=2).encode()
    if not put_new_file(number_path(folder, number), data):
        raise Conflict(f"{folder} has a version {number} already; begin again from it")
    put_small_file(f"{folder}/{MANIFEST}", data)
    if base and base["number"] > 1:
        older = number_path(folder, base["number"] - 1)
        try:
            unused = named(json.loads(small_file(older))) - named(entry) - named(base)
        except FileNotFoundError:
            return entry
        graphs = {x.split("/")[0] for x in named(entry) | named(base) if "/" in x}
        for name in unused:
            own = name.split("/")[0]
            files.deleted(spark, f"{folder}/{own if '/' in name and own not in graphs else name}")
        files.deleted(spark, older)
    return entry


def put_table(rows: DataFrame, folder: str, kind: str) -> str:
    name = f"{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    return name


def current(folder: str) -> dict | None:
    """The latest version's manifest, or None."""
    try:
        return manifest(folder)
    except NoIndex:
        return None


def save(vectors: DataFrame, folder: str, config: IndexConfig, graph: bool = False, base: dict | None = None, ledger: DataFrame | None = None, settings: dict | None = None) -> dict:
    """A version with all rows in one segment, and a graph of them if asked for.  ``base``: the version that it follows, by default the latest."""
    spark = vectors.sparkSession
    base = base or current(folder)
    name = put_table(vectors, folder, "s")
    rows = spark.read.schema(vectors.schema).parquet(f"{folder}/{name}")
    n, top = rows.agg(F.count("*"), F.coalesce(F.max("chunk_id"), F.lit(-1))).first()
    built = None
    if graph and n:
        inside = f"g-{uuid.uuid4().hex}"
        built = {"folder": inside, "entry": routed.build(rows, f"{folder}/{inside}", config, "chunk_id", "vector").entry}
    entry = {"segments": [name], "dead": [], "rows": n, "dead_rows": 0, "next_id": top + 1, "graph": built, "files": put_table(ledger, folder, "f") if ledger is not None else None, "settings": settings, "config": json.loads(config.dumps())}
    return committed(spark, folder, base, entry)


def extended(spark: SparkSession, folder: str, base: dict, added: DataFrame, dead: DataFrame, ledger: DataFrame | None = None, settings: dict | None = None) -> dict:
    """The version after ``base`` with the rows of ``added`` and without those whose chunk_id is in ``dead``.

    Writes these alone, and their changes to the graph.  Ids of added rows must be ``base["next_id"]`` or larger.  Nothing to change and the same ledger give ``base`` itself.
    """
    config = config_of(base)
    name, gone = put_table(added, folder, "s"), put_table(dead.select(F.col("chunk_id").cast("long")).distinct(), folder, "x")
    fresh, out = spark.read.schema(added.schema).parquet(f"{folder}/{name}"), spark.read.schema("chunk_id long").parquet(f"{folder}/{gone}")
    (n, top), m = fresh.agg(F.count("*"), F.max("chunk_id")).first(), out.count()
    for unused in [x for x, k in ((name, n), (gone, m)) if not k]:
        files.deleted(spark, f"{folder}/{unused}")
    graph = base["graph"]
    if graph and (n or m):
        index = graph_of(spark, folder, base)
        graph = graph | {"entry": routed.updated(index, fresh if n else None, out if m else None, "chunk_id", "vector", save=False).entry}
        rebuild = routed.outgrown(graph["entry"])
    else:
        rebuild = False
    entry = base | {
        "segments": base["segments"] + [name] * bool(n), "dead": base["dead"] + [gone] * bool(m), "rows": base["rows"] + n - m, "dead_rows": base["dead_rows"] + m,
        "next_id": max(base["next_id"], (top if n else -1) + 1), "graph": graph, "files": put_table(ledger, folder, "f") if ledger is not None else base["files"], "settings": settings or base["settings"],
    }
    if not n and not m and ledger is None:
        return base
    if len(entry["segments"]) > SEGMENTS or entry["dead_rows"] > DEAD * max(1, entry["rows"]):
        whole = put_table(table_of(spark, folder, entry), folder, "s")
        for part in (name, gone):  # no version names these
            files.deleted(spark, f"{folder}/{part}")
        entry |= {"segments": [whole], "dead": [], "dead_rows": 0}
    if rebuild:
        inside = f"g-{uuid.uuid4().hex}"
        entry["graph"] = {"folder": inside, "entry": routed.build(table_of(spark, folder, entry), f"{folder}/{inside}", config, "chunk_id", "vector").entry}
    return committed(spark, folder, base, entry)


def table_of(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    """A version's rows: those of all segments whose ids aren't dead."""
    rows = spark.read.parquet(*[f"{folder}/{s}" for s in entry["segments"]])
    if entry["dead"]:
        dead = spark.read.schema("chunk_id long").parquet(*[f"{folder}/{d}" for d in entry["dead"]])
        rows = rows.join(dead.withColumnRenamed("chunk_id", "__dead"), F.col("chunk_id") == F.col("__dead"), "left_anti")
    return rows


def ledger_of(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    """A row for each file that a version was made from (see LEDGER); empty where it has no ledger."""
    return spark.read.schema(LEDGER).parquet(f"{folder}/{entry['files']}") if entry["files"] else spark.createDataFrame([], LEDGER)


def graph_of(spark: SparkSession, folder: str, entry: dict) -> routed.Index | None:
    graph = entry["graph"]
    if not graph:
        return None
    inside = f"{folder}/{graph['folder']}"
    return routed.Index(spark, inside, graph["entry"], IndexConfig(**graph["entry"]["config"]), routed.router_of(spark, inside, graph["entry"]))


def config_of(entry: dict) -> IndexConfig:
    return IndexConfig.loads(json.dumps(entry["config"]))


@contextmanager
def staged(rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """``rows`` as a table beside the index's versions, which is gone afterwards: they are computed once, however often they are read."""
    spark = rows.sparkSession
    path = f"{folder}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        files.deleted(spark, path)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, routed.Index | None, IndexConfig]:
    """The latest version's rows, graph and settings."""
    entry = manifest(folder)
    return table_of(spark, folder, entry), graph_of(spark, folder, entry), config_of(entry)


def export(vectors: DataFrame, folder: str, config: IndexConfig | None = None, strict: bool = True) -> int:
    """The exchange form.  ``vectors``: the metadata fields and vector; ids should be 0 to n - 1."""
    n = vectors_bin.write(vectors, os.path.join(folder, VECTORS), config.dim if config and strict else None, strict)
    metadata.write(vectors, os.path.join(folder, METADATA), NAMES, "chunk_id")
    replaced(os.path.join(folder, CONFIG), lambda f: f.write((config or IndexConfig(dim=vectors_bin.header(os.path.join(folder, VECTORS))[1] or 384)).dumps().encode()))
    return n


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Every record must have every field, and there must be one."""
    rows = metadata.read(spark, path, FIELDS)
    lacking = rows.agg(F.count("*"), *[F.count_if(F.col(n).isNull()) for n in NAMES]).first()
    if not lacking[0]:
        raise ValueError(f"{path} has no records")
    if missing := [n for n, k in zip(NAMES, lacking[1:], strict=True) if k]:
        raise ValueError(f"records of {path} lack {missing}")
    return rows


def import_(spark: SparkSession, folder: str, dim: int | None = None) -> tuple[DataFrame, IndexConfig]:
    """Vectors with their metadata, joined on chunk_id; missing or bad settings are replaced by the defaults."""
    vectors = vectors_bin.read(spark, os.path.join(folder, VECTORS), dim)
    n, found = vectors_bin.header(os.path.join(folder, VECTORS), dim, False)
    records = read_metadata(spark, os.path.join(folder, METADATA))
    if (m := records.count()) != n:
        raise ValueError(f"{n} vectors and {m} records")
    try:
        with open(os.path.join(folder, CONFIG)) as f:
            config = IndexConfig.loads(f.read(), found)
    except (OSError, ValueError):
        config = IndexConfig(dim=found)
    return records.join(vectors, "chunk_id"), config


def validate(spark: SparkSession, folder: str) -> bool:
    """Whether an index, or the files of the exchange form, can be read, have as many rows as they say, distinct ids and finite vectors of one length.

    Of an index the graph must have the same ids.
    """
    try:
        if index_exists(folder):
            entry = manifest(folder)
            rows, graph, config = table_of(spark, folder, entry), graph_of(spark, folder, entry), config_of(entry)
            sound = is_finite(F.col("vector")) & (F.size("vector") == config.dim)
            n, ids, good = rows.agg(F.count("*"), F.countDistinct("chunk_id"), F.count_if(sound)).first()
            apart = 0 if graph is None else rows.select(F.col("chunk_id").alias("id")).exceptAll(graph.ids()).unionAll(graph.ids().exceptAll(rows.select("chunk_id"))).count()
            return n == ids == good == entry["rows"] and not apart
        rows, _ = import_(spark, folder)
        n, _ = vectors_bin.header(os.path.join(folder, VECTORS), None, False)
        return rows.where(is_finite(F.col("vector"))).count() == n
    except (OSError, ValueError, KeyError, PySparkException) as e:
        logging.getLogger(__name__).info("%s is not valid: %s", folder, e)
        return False


def stats(spark: SparkSession, folder: str) -> dict | None:
    """Of an index its manifest, files and graph; of another folder ``export_stats``."""
    if not index_exists(folder):
        return export_stats(folder)
    entry = manifest(folder)
    graph, config = graph_of(spark, folder, entry), config_of(entry)
    n_files, chunks, words = table_of(spark, folder, entry).agg(F.countDistinct("source_file"), F.count("*"), F.coalesce(F.sum("word_count"), F.lit(0))).first()
    found = {"rows": entry["rows"], "files": n_files, "chunks": chunks, "words": words, "dim": config.dim, "space": config.space, "written": entry["written"], "version": entry["number"], "segments": len(entry["segments"]), "dead_rows": entry["dead_rows"], "graph": graph is not None}
    if graph is None:
        return found
    inside = routed.stats(graph)
    return found | {n: inside[n] for n in ("cells", "shards", "probes", "changed")}


def export_stats(folder: str) -> dict | None:
    """From the header, the records' count and file sizes alone; None without a folder."""
    if not os.path.isdir(folder):
        return None
    path = {n: os.path.join(folder, n) for n in (VECTORS, METADATA, CONFIG)}
    out = {f"has_{n.split('.')[0]}": os.path.isfile(p) for n, p in path.items()} | {f"{n.split('.')[0]}_bytes": os.path.getsize(p) for n, p in path.items() if os.path.isfile(p)}
    try:
        out["vectors"], out["dim"] = vectors_bin.header(path[VECTORS], None, False)
        out["records"] = metadata.count(path[METADATA])
        out["valid"] = out["vectors"] == out["records"]
    except (OSError, ValueError):
        out["valid"] = False
    return out


def index_path(folder: str) -> str:
    return os.path.join(folder, MANIFEST)


def index_exists(folder: str) -> bool:
    """Whether a version can be read: the manifest, or a first version whose writer didn't come to write it."""
    for path in (index_path(folder), number_path(folder, 1)):
        try:
            small_file(path)
            return True
        except FileNotFoundError:
            continue
    return False
