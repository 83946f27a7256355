"""Text clean-up as column expressions; Unicode composition alone needs a Pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's ``str.strip`` knows it.
BLANK = r"[\s\x1c-\x1f]"
LONGEST, SHORTEST = 5_000_000, 3


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def _lines(text: Column, clean) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), clean), "\n")


def _plain(text: Column) -> Column:
    """NFC, no-break spaces as spaces, no zero-width characters, LF line ends."""
    text = F.translate(nfc(text), "\u00a0\u200b\u200c\u200d\ufeff", " ")
    return F.regexp_replace(text, "\r\n?", "\n")


def normalise(text: Column) -> Column:
    """Lines lose the white space around them; at most two blank lines stay in a row."""
    lines = _lines(_plain(text), lambda x: F.regexp_replace(x, rf"(?U)\A{BLANK}+|{BLANK}+\z", ""))
    return stripped(F.regexp_replace(lines, "\n{4,}", "\n\n\n"))


def normalise_code(text: Column) -> Column:
    """As ``normalise``, but lines keep their indent (the first one's goes with the text's leading white space)."""
    lines = _lines(_plain(text), lambda x: F.regexp_replace(x, rf"(?U){BLANK}+\z", ""))
    return stripped(F.regexp_replace(lines, "\n{4,}", "\n\n\n"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def decoded(content: Column) -> Column:
    """UTF-8 (a leading byte-order mark goes), else Latin-1, with LF line ends."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "\\A\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def extension(path: Column) -> Column:
    """Last suffix with its dot, in lower case; empty for names like ``.env`` and without a dot."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def human_bytes(n: Column) -> Column:
    """``1.5 KB``: powers of 1024, one decimal."""
    n = n.cast("double")
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n / 1024**power, 1))  # noqa: E731  halves to even
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def linearized(names: list[str]) -> Column:
    """``name: value | name: value``; nulls and blanks are skipped."""
    parts = [F.when(F.coalesce(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.trim(F.col(f"`{n}`").cast("string")))) for n in names]
    return F.concat_ws(" | ", *parts)
