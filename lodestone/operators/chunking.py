"""Documents cut into overlapping chunks under a token limit.

All strategies are one fold: units (sentences, code blocks or rows) gather until the next one would make
them too long; what is gathered becomes a chunk, and a strategy says what of it seeds the next.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

SIZE, OVERLAP, LIMIT = 120, 30, 256
BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*\n\s*(?=\S)")
BLANK_LINE = re.compile(r"\n\s*\n")
TOKEN = re.compile(r"\w{1,6}|[^\w\s]")


@dataclass(frozen=True)
class Settings:
    """``overlap`` at or over ``size`` becomes size - 1; ``ratio`` tells whether it is the recommended 25 to 30 %."""

    size: int = SIZE
    overlap: int = OVERLAP
    limit: int = LIMIT

    def __post_init__(self):
        if self.size < 1 or self.overlap < 0 or self.limit < 1:
            raise ValueError("size and limit must be at least 1, overlap at least 0")
        if self.overlap >= self.size:
            object.__setattr__(self, "overlap", self.size - 1)

    @property
    def ratio_advised(self) -> bool:
        return 0.25 <= self.overlap / self.size <= 0.30


def sentences(text: str) -> list[str]:
    """Pieces between sentence ends and capitals, or at blank lines; one that begins in lower case joins the piece before it."""
    out: list[str] = []
    for piece in filter(None, map(str.strip, BOUNDARY.split(text))):
        if out and piece[0].islower():
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def fold(units: list[tuple[str, list[str]]], size: int, join: Callable[[list], str], seed: Callable[[list], list]) -> list[str]:
    """``units``: (text, words).  ``seed``: the units that open the chunk after the given ones."""
    chunks, held, n = [], [], 0
    for unit in units:
        more = len(unit[1])
        if not more:
            continue
        if n and n + more > size:
            chunks.append(join(held))
            held = seed(held)
            n = sum(len(w) for _, w in held)
        held = [*held, unit]
        n += more
    if held:
        chunks.append(join(held))
    return chunks


def by_sentences(text: str, size: int = SIZE, overlap: int = OVERLAP, cut: Callable[[str], list[str]] = sentences) -> list[str]:
    """The next chunk opens with the last ``overlap`` words, if the last chunk has more than that."""

    def seed(held):
        words = [w for _, ws in held for w in ws]
        return [("", words[-overlap:])] if 0 < overlap < len(words) else []

    return fold([(s, s.split()) for s in cut(text)], size, lambda held: " ".join(w for _, ws in held for w in ws), seed)


def by_blocks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The next chunk opens with the last block, or its last ``overlap`` words if it is longer."""

    def seed(held):
        if not overlap:
            return []
        block, words = held[-1]
        return [(block, words) if len(words) <= overlap else (" ".join(words[-overlap:]), words[-overlap:])]

    blocks = [b.strip() for b in BLANK_LINE.split(text)]
    return fold([(b, b.split()) for b in blocks], size, lambda held: "\n\n".join(b for b, _ in held), seed)


def by_rows(text: str, size: int = SIZE) -> list[str]:
    rows = [r.strip() for r in text.split("\n")]
    return fold([(r, r.split()) for r in rows], size, lambda held: "\n".join(r for r, _ in held), lambda held: [])


def count_tokens(text: str) -> int:
    """A stand-in for a model's tokenizer: marks, and words by six letters."""
    return len(TOKEN.findall(text))


count_tokens.adds_up = True


class FileCounter:
    """Counts the tokens of a model by its tokenizer file, as the ``tokenizers`` library reads it; loaded once in each worker."""

    adds_up = False

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return len(loaded(self.path).encode(text).ids)


@lru_cache(4)
def loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def guarded(chunks: list[str], limit: int = LIMIT, overlap: int = OVERLAP, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks over ``limit`` tokens become overlapping runs of words that fit; a single word over it stays whole.

    A counter that adds up over words joined by spaces (``adds_up``) is asked once for each word; of others the longest run that fits is searched for.
    """
    out = []
    for chunk in chunks:
        if count(chunk) <= limit:
            out.append(chunk)
            continue
        words, at = chunk.split(), 0
        sums = [0, *accumulate(map(count, words))] if getattr(count, "adds_up", False) else None
        while at < len(words):
            if sums:
                n = max(1, bisect_right(sums, sums[at] + limit) - 1 - at)
            else:
                low, high = 1, len(words) - at
                while low < high:
                    mid = (low + high + 1) // 2
                    if count(" ".join(words[at : at + mid])) <= limit:
                        low = mid
                    else:
                        high = mid - 1
                n = low
            out.append(" ".join(words[at : at + n]))
            if at + n >= len(words):
                break
            at += max(n - overlap, 1)
    return out


def chunk_text(text: str, category: str | None, settings: Settings, count: Callable[[str], int] | None = count_tokens, cut: Callable[[str], list[str]] = sentences) -> list[str]:
    if category == "source_code":
        chunks = by_blocks(text, settings.size, settings.overlap)
    elif category == "spreadsheet":
        chunks = by_rows(text, settings.size)
    else:
        chunks = by_sentences(text, settings.size, settings.overlap, cut)
    if count is None:
        return chunks
    return guarded(chunks, settings.limit, 0 if category == "spreadsheet" else settings.overlap, count)


CHUNK = "array<struct<text: string, word_count: int, token_count: int>>"


def chunked(units: DataFrame, settings: Settings = Settings(), text: str = "text", category: str = "format_category", count: Callable[[str], int] | None = count_tokens, cut: Callable[[str], list[str]] = sentences) -> DataFrame:
    """Adds ``chunks`` to rows of units; one row stays one row, so order and source are never lost.

    Blank and null texts have no chunks.  A missing category column means prose.  ``cut``: what makes sentences of prose, as a trained ``functions.sentences.Model`` does.
    """
    ship(units.sparkSession)
    kind = F.col(category) if category in units.columns else F.lit(None).cast("string")
    names = [f"c{i}" for i in range(len(units.columns))]
    rows = units.select(F.col(text).alias("__text"), kind.alias("__kind"), *[F.col(f"`{c}`").alias(n) for c, n in zip(units.columns, names, strict=True)])
    arrow = pa.list_(pa.struct([("text", pa.string()), ("word_count", pa.int32()), ("token_count", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made.append([{"text": c, "word_count": len(c.split()), "token_count": count(c) if count else 0} for c in chunk_text(t or "", k, settings, count, cut)])
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(made, arrow)], [*names, "chunks"])

    schema = ", ".join(f"{n} {units.schema[c].dataType.simpleString()}" for c, n in zip(units.columns, names, strict=True))
    done = rows.mapInArrow(run, f"{schema}, chunks {CHUNK}")
    return done.select(*[F.col(n).alias(c) for c, n in zip(units.columns, names, strict=True)], "chunks")


def exploded(rows: DataFrame, document: list[str], unit: str) -> DataFrame:
    """One row for each chunk, numbered from 0 within its document (``document`` columns) across its units (``unit``: their order).

    Numbers come from counts of chunks before a unit in its document: units, with their chunks, go through one shuffle by document.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(*document).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.withColumn("__ahead", F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0)))
    return ahead.select(*rows.drop("chunks").columns, "__ahead", F.posexplode("chunks").alias("__at", "chunk")).select(
        *rows.drop("chunks").columns, (F.col("__ahead") + F.col("__at")).cast("int").alias("chunk_index"), F.col("chunk.text").alias("chunk_text"), "chunk.word_count", "chunk.token_count"
    )
