"""A corpus pipeline of the operators in ``lodestone.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents, of any names.  Rows with null or
repeated ids, null, empty and very long texts and extra columns pass through every stage by the rules of its operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm import packing, simhash, substring, toxicity
from lodestone.llm.common import carried, clear, made, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of the whole documents table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, back = carried(docs, "doc_id", "text")
    return back(toxicity.scored(rows, model).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: a row with the group's smallest id.

    Rows are judged by id and text, so of different texts under one id each is judged on its own.  Of rows
    that share the smallest id within a group one stays, one of the text with the smallest hash; ids come before null ones,
    so a group without any id keeps one row too.
    """
    rows, back = carried(docs, "doc_id", "text")
    keyed = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__hash", F.xxhash64("text"))
    found = simhash.near_duplicates(keyed, columns=["__id", "__hash"])
    least = F.min(F.struct(F.col("__id") == -(1 << 63), "__id", "__hash")).alias("least")
    first = found.groupBy("group").agg(least).select("least.__id", "least.__hash")
    again = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__hash"))  # of equal rows, by the join's own partitions
    return back(keyed.join(first, ["__id", "__hash"]).withColumn("__again", again).where("__again = 1"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier go from the texts; documents of which nothing is left go whole.

    Empty and null texts lose nothing and stay.  n_chars, if it is a whole number, follows the text.
    """
    rows, back = carried(docs, "doc_id", "text")
    found = substring.without_repeats(rows).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0

    def new(old: dict[str, Column]) -> dict[str, Column]:
        values = {"text": F.when(changed, F.col("kept")).otherwise(old["text"])}
        counts = "n_chars" in old and isinstance(docs.schema["n_chars"].dataType, IntegralType)
        return values | ({"n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(old["n_chars"])} if counts else {})

    return back(found, new)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, fingerprints and a tokenizer: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written and read again; what a stage wrote besides goes when its result is there."""
    docs = table(spark, sf_dir, "documents")
    since = made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
            clear(spark, since, keep=docs)
    return docs
