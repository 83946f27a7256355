"""python -m lodestone.cli scan|extract|chunk|index|search|learn|stats|validate|export|import|embed ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import meaning
from lodestone.functions.embedding import HashEmbedder
from lodestone.operators import incremental
from lodestone.operators.chunking import Settings
from lodestone.operators.summaries import run_totals, scan_summary, status_counts
from lodestone.plans import retrieval
from lodestone.plans.config import IndexConfig
from lodestone.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "extract", "chunk", "index", "learn"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("--max-size", type=float, default=500, help="largest file in MB")
        c.add_argument("--max-files", type=int, default=0)
        c.add_argument("--follow-symlinks", action="store_true")
        c.add_argument("--include-hidden", action="store_true")
        c.add_argument("--ignore", action="append", default=[])
        c.add_argument("--json", action="store_true")
        if name in ("chunk", "index", "learn"):
            c.add_argument("--size", type=int, default=120)
            c.add_argument("--overlap", type=int, default=30)
            c.add_argument("--token-limit", type=int, default=256)
        if name == "index":
            c.add_argument("folder")
            c.add_argument("--dim", type=int, default=384)
            c.add_argument("--full", action="store_true")
            c.add_argument("--model", help="a folder made by learn, instead of the hashing embedder")
        if name == "learn":
            c.add_argument("model", help="folder for word vectors learned from the tree's texts")
            c.add_argument("--dim", type=int, default=128)
    s = sub.add_parser("search")
    s.add_argument("folder")
    s.add_argument("text")
    s.add_argument("-k", type=int, default=5)
    s.add_argument("--exact", action="store_true")
    s.add_argument("--model", help="the folder that the index was made with")
    for name in ("stats", "validate"):
        sub.add_parser(name, help="of an index, or of a folder in the exchange form").add_argument("folder")
    for name, source, target in (("export", "index", "folder"), ("import", "folder", "index")):
        c = sub.add_parser(name, help=f"from {source} to {target}")
        c.add_argument("source")
        c.add_argument("target")
    e = sub.add_parser("embed", help="the vector of a text, as JSON")
    e.add_argument("text")
    e.add_argument("--dim", type=int, default=384)
    return p


def exchangeable(vectors: DataFrame) -> DataFrame:
    """Ids from 0 to n - 1 in the order of the index's, as the exchange form has them by position."""
    return incremental.numbered(vectors.withColumnRenamed("chunk_id", "old_id"), ["old_id"]).drop("old_id")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "embed":
        print(json.dumps(HashEmbedder(a.dim).encode([a.text])[0].tolist()))
        return 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        if a.command == "stats":
            found = store.stats(spark, a.folder)
            print(json.dumps(found, indent=2))
            return int(found is None)
        if a.command == "export":
            vectors, _, config = store.load(spark, a.source)
            print(f"{store.export(exchangeable(vectors), a.target, config)} vectors")
            return 0
        if a.command == "import":
            vectors, config = store.import_(spark, a.source)
            # chunks of a unit in the order of their ids, which is how they were cut
            place = F.row_number().over(Window.partitionBy("source_file", "source_chunk_index").orderBy("chunk_id")) - 1
            vectors = vectors.withColumn("chunk_index", place.cast("int"))
            print(json.dumps(store.save(vectors.select(*retrieval.COLUMNS), a.target, config, True), indent=2))
            return 0
        if a.command == "validate":
            ok = store.validate(spark, a.folder)
            print("valid" if ok else "not valid")
            return int(not ok)
        if a.command == "search":
            make = meaning.Meaning(spark, meaning.load(spark, a.model)) if a.model else None
            for r in retrieval.search(spark, a.folder, a.text, a.k, make, a.exact).collect():
                print(f"{r['rank']}. {r['score']:.4f} {r['source_file']} ({r['source_label']})\n   {r['text'][:300]}")
            return 0
        options = {"max_file_size_mb": a.max_size, "max_files": a.max_files, "follow_symlinks": a.follow_symlinks, "include_hidden": a.include_hidden, "ignore": a.ignore}
        settings = Settings(a.size, a.overlap, a.token_limit) if a.command in ("chunk", "index", "learn") else Settings()
        if a.command == "index":
            model = meaning.load(spark, a.model) if a.model else None
            config, make = IndexConfig(dim=model.dim if model else a.dim), meaning.Meaning(spark, model) if model else None
            print(json.dumps(retrieval.index(spark, a.root, a.folder, config, settings, make, a.full, **options), indent=2))
            return 0
        if a.command == "learn":
            chunks = retrieval.ingest(spark, a.root, settings, **options).chunks.select("text").persist()
            model = meaning.train(chunks, a.dim)
            chunks.unpersist()
            meaning.save(spark, model, a.model)
            print(f"{len(model.words)} words, {model.dim} components")
            return 0
        found = retrieval.ingest(spark, a.root, settings, **options)
        rows = {"scan": found.log, "extract": found.extractions, "chunk": found.chunks}[a.command]
        if a.json:
            for line in rows.toJSON().toLocalIterator():
                print(line)
        elif a.command == "scan":
            scan_summary(found.log).orderBy("status", F.desc("files")).show(100, False)
        elif a.command == "extract":
            status_counts(found.extractions).show()
        else:
            documents = found.documents().persist()
            documents.orderBy("source_file").show(100, False)
            run_totals(documents).show()
            documents.unpersist()
        return 0
    except (store.NoIndex, store.Conflict, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
