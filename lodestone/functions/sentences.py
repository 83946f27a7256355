"""Sentence ends learned from a corpus without labels (after Kiss and Strunk, 2006).

Whether a full stop ends a sentence depends on the word before it.  Abbreviations are words that nearly always have one: their counts with and without give a
log-likelihood ratio, which short words and those with inner stops need less of, and words often seen without a stop more.  What follows abbreviations tells which of them
end sentences at all: a capital on a word that is else written small is a sentence's start.  All counts are made in Spark by word; the model is a bounded dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least score of an abbreviation; least times that it was seen; and part of its uses that must come before a sentence's start for it to end sentences.
LEAST, SEEN, ENDS = 0.3, 2, 0.1
#: Abbreviations, and words known to be written small, in a model at most: those seen most.
MOST, SMALL = 20_000, 50_000
NUMBER = "#"

EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
#: Where a sentence may end: marks, what closes, white space.
CANDIDATE = re.compile("[.!?…]+[\"'”’»)\\]]*\\s+")
BLANK_LINES = re.compile(r"(?<=\n)\s*\n\s*(?=\S)")
OPENING = "\"'“‘«([¿¡„"


def word_type(bare: Column) -> Column:
    """A word without its last stop, in lower case; all numbers are one word."""
    plain = F.regexp_replace(F.lower(bare), r"\.$", "")
    return F.when(plain.rlike(r"^[\p{N}][\p{N}.,]*$"), F.lit(NUMBER)).otherwise(plain)


def pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, dotted (it has one last stop), next (the word that follows, or null), capital and small (how that begins) of each word of each text."""
    words = F.filter(F.transform(F.split(F.col(f"`{text}`"), r"\s+"), lambda w: F.regexp_replace(w, EDGE, "")), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    both = docs.select(words.alias("ws")).select(F.explode(F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.greatest(F.size("ws"), F.lit(1))).alias("x"))).alias("p")).select("p.w", "p.x").where("w IS NOT NULL")
    return both.select(
        word_type(F.col("w")).alias("word"), F.col("w").rlike(r"[^.]\.$").alias("dotted"), F.col("w").rlike(r"^\p{Lu}").alias("is_capital"), F.col("w").rlike(r"^\p{Ll}").alias("is_small"),
        word_type(F.col("x")).alias("next"), F.coalesce(F.col("x").rlike(r"^\p{Lu}"), F.lit(False)).alias("capital"), F.coalesce(F.col("x").rlike(r"^\p{Ll}"), F.lit(False)).alias("small"),
    )


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, dotted, plain (how often with and without a stop), lower (how often written small), dotted_small (with a stop before a small word)."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    return pairs(docs, text).groupBy("word").agg(one(F.col("dotted")).alias("dotted"), one(~F.col("dotted")).alias("plain"), one(F.col("is_small")).alias("lower"), one(F.col("dotted") & F.col("small")).alias("dotted_small"))


def scored(found: DataFrame, dotted: int, total: int) -> DataFrame:
    """Adds the score of each word as an abbreviation."""
    p = min(max(dotted / max(1, total), 1e-9), 1 - 1e-9)
    k, n = F.col("dotted"), F.col("plain")
    ratio = 2 * (k * F.log(F.lit(0.99 / p)) + n * F.log(F.lit(0.01 / (1 - p))))
    letters = F.length(F.regexp_replace("word", r"[^\p{L}\p{N}]", ""))
    inner = F.length(F.regexp_replace("word", r"[^.]", "")) + 1
    return found.withColumn("score", ratio * F.exp(-letters) * inner / F.pow(F.greatest(letters, F.lit(1)).cast("double"), n))


@dataclass(frozen=True)
class Model:
    """``ends``: abbreviation -> whether it may end a sentence; ``small``: words that are mostly written small."""

    ends: dict[str, bool] = field(default_factory=dict)
    small: frozenset = frozenset()

    def boundary(self, before: str, mark: str, after: str) -> bool:
        """Whether a sentence ends between two words (``before`` has its marks off)."""
        first = after.lstrip(OPENING)[:1]
        if first.islower():
            return False
        if mark != ".":
            return True
        word = before.lower()
        if re.fullmatch(r"\d[\d.,]*", word):
            word = NUMBER
        if len(word) == 1 and word.isalpha():
            known = False
        elif word in self.ends:
            known = self.ends[word]
        else:
            return True
        after = re.sub(r"^\W+|\W+$", "", after).lower()
        return known and after in self.small

    def __call__(self, text: str) -> list[str]:
        """The sentences of a text; blank lines end them too."""
        out: list[str] = []
        for block in BLANK_LINES.split(text):
            start = 0
            for m in CANDIDATE.finditer(block):
                if m.end() == len(block):
                    break
                marks = m.group().rstrip()
                word = re.search(r"[^\s\"'“‘«(\[„]*\Z", block[max(start, m.start() - 64) : m.start()]).group()
                end = block.find(" ", m.end())
                after = block[m.end() : min(len(block), m.end() + 64) if end < 0 else min(end, m.end() + 64)].split()[0]
                if self.boundary(word, marks.rstrip("\"'”’»)]"), after):
                    out.append(block[start : m.end()].strip())
                    start = m.end()
            out.append(block[start:].strip())
        return [s for s in out if s]


def cut_texts(model: Model) -> Callable[[pd.Series], pd.Series]:
    """For a Pandas UDF: the sentences of each text; a null text has none."""
    return lambda texts: texts.map(lambda t: model(t or ""))


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts the words of all texts twice; null and empty texts have none.  Of abbreviations and of words written small those seen most come to the driver, MOST and SMALL of them."""
    found = counts(docs, text)
    dotted, total = found.agg(F.coalesce(F.sum("dotted"), F.lit(0)), F.coalesce(F.sum(F.col("dotted") + F.col("plain")), F.lit(0))).first()
    if not dotted:
        return Model()
    often_small = (F.col("dotted") >= 3) & (F.col("dotted_small") >= 0.5 * F.col("dotted")) & (F.col("dotted") > F.col("plain"))
    good = scored(found, dotted, total).where(((F.col("score") >= LEAST) & (F.col("dotted") >= SEEN) & (F.col("dotted_small") > 0)) | often_small)
    abbreviations = [r[0] for r in good.orderBy(F.desc("dotted"), "word").limit(MOST).select("word").collect()]
    small = frozenset(r[0] for r in found.where((F.col("lower") >= 2) & (2 * F.col("lower") >= F.col("dotted") + F.col("plain"))).orderBy(F.desc(F.col("dotted") + F.col("plain")), "word").limit(SMALL).select("word").collect())
    if not abbreviations:
        return Model({}, small)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in abbreviations], "word string"))
    starts = F.broadcast(spark.createDataFrame([(w, True) for w in sorted(small)] or [("", True)], "next string, known boolean"))
    after = pairs(docs, text).where("dotted").join(wanted, "word").join(starts, "next", "left")
    share = after.groupBy("word").agg(F.avg(F.when(F.col("capital") & F.col("known"), 1.0).otherwise(0.0)).alias("share")).collect()  # at most MOST
    return Model({r["word"]: r["share"] >= ENDS for r in share}, small)
