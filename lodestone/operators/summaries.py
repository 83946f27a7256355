"""Counts and totals over documents, units and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import word_count


def doc_totals(units: DataFrame, document: str, text: str = "text") -> DataFrame:
    """Each document's units, words and characters."""
    return units.groupBy(document).agg(F.count("*").alias("units"), F.sum(word_count(F.col(text))).cast("long").alias("total_words"), F.sum(F.length(text)).cast("long").alias("total_chars"))


def full_text(units: DataFrame, document: str, order: str, text: str = "text", join: str = "\n\n") -> DataFrame:
    """Each document's texts in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return units.groupBy(document).agg(F.array_join(F.transform(parts, lambda p: p["t"]), join).alias("full_text"))


def status_counts(rows: DataFrame, success: str = "success") -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(success), F.lit(False))).alias("successful"), F.count_if(~F.coalesce(F.col(success), F.lit(False))).alias("failed"))


def run_totals(documents: DataFrame) -> DataFrame:
    """One row: documents, successful and failed ones, and the units, chunks, words and tokens of the successful."""
    good = F.coalesce(F.col("success"), F.lit(False))
    totals = [F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(f"total_{c}") for c in ("units", "chunks", "words", "tokens")]
    return documents.agg(F.count("*").alias("documents"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), *totals)


def scan_summary(log: DataFrame) -> DataFrame:
    """Rows and bytes by status and reason."""
    return log.groupBy("status", "reason").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def first_of(rows: DataFrame, by, order: str) -> DataFrame:
    """The first row of each value of ``by``; a value's rows are pre-aggregated before the shuffle."""
    packed = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(by.alias("__key")).agg(F.min_by(packed, order).alias("row")).select("row.*")
