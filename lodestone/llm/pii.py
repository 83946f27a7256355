"""Personal data in plain and in disguised form, with places in the source text.

Plain identifiers are found by their patterns.  For disguised ones a chain of transducers rewrites a text: look-alike characters
become ASCII and invisible ones go, letters among digits and spelled digits become digits, bracketed and spoken "at" and "dot" become
their signs.  Each rewritten character knows which characters of the source it stands for, so what the same
patterns find in the rewritten text maps back to source spans.  Spans found so are added; plain ones never change.

All steps go through a text once: starts of matches are found by characters that no other part of the pattern has, or behind a
boundary, so that long runs of letters, digits or spaces cost no more than others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The kinds, in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9][0-9.]*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SEPARATORS = str.maketrans("", "", " -().+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By their @, from which the local part goes back as far as it can."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            last = domain.end()
            yield start, last
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in NUMBERS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        for m in IP.finditer(text, *run.span()):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                yield m.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().translate(SEPARATORS)
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(m.group().translate(SEPARATORS)) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


class Rewritten:
    """A text after some edits; character i stands for the source from ``starts[i]`` to ``ends[i]`` and was ``edited`` or not.

    ``low`` is the text in lower case, character by character.
    """

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.edited = text, None, None, None
        self.low = lower(text)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces stretches (start, end), in order and apart, by at most one character each."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = np.arange(len(self.text)), np.arange(1, len(self.text) + 1)
            self.edited = np.zeros(len(self.text), bool)
        first, last = np.array([e[0] for e in edits]), np.array([e[1] for e in edits])
        # each edit keeps its first place for the new character, if there is one, and drops the others
        keep = np.ones(len(self.text) + 1, np.int64)
        keep[:-1] -= np.cumsum(np.bincount(first, minlength=len(self.text) + 1) - np.bincount(last, minlength=len(self.text) + 1))[:-1]
        some = np.array([bool(e[2]) for e in edits])
        keep[first[some]] = 1
        self.ends[first] = self.ends[last - 1]
        self.edited[first] = True
        gone = first[~some]
        self.edited[gone[gone > 0] - 1] = True  # where a character goes, the one before it tells
        kept = keep[:-1].astype(bool)
        self.starts, self.ends, self.edited = self.starts[kept], self.ends[kept], self.edited[kept]
        parts, at = [], 0
        for start, end, new in edits:
            parts += (self.text[at:start], new)
            at = end
        self.text = "".join([*parts, self.text[at:]])
        self.low = lower(self.text)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


#: Letters of other scripts that look like an ASCII one, by script.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXaesijopcyxhdqw"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυ", "ABEZHIKMNOPTYXovu"),
    "dashes and dots": ("‐‑‒–—−。", "------."),
}
#: Characters that show nothing.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

#: The digits from zero to nine by language, and words for @, a dot and a plus sign.
DIGITS = {
    "en": ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    "de": ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    "fr": ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    "es": ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punto", "punkt", "point")
PLUS_WORDS = ("plus", "más")

VALUE = {w: str(i) for words in DIGITS.values() for i, w in enumerate(words)}
SPELLED = re.compile(rf"\b(?:{'|'.join(sorted(VALUE, key=len, reverse=True))})\b")
AMONG = re.compile("[0-9][OoIl](?=[0-9])")
PLUS = re.compile(rf"\b(?:{'|'.join(PLUS_WORDS)})\s{{1,3}}(?=[0-9])")
BRACKETED = re.compile(rf"[\[({{<]\s{{0,3}}({'|'.join(AT_WORDS)}|@|{'|'.join(DOT_WORDS)}|\.)\s{{0,3}}[\])}}>]")
SPOKEN_AT = re.compile(rf"\s({'|'.join(AT_WORDS)})\s")
SAID = rf"\s{{1,3}}(?:{'|'.join(DOT_WORDS)})\s{{1,3}}"
SPOKEN_DOT = re.compile(SAID)
AMONG_NUMBERS = re.compile(rf"[0-9]({SAID})(?=[0-9])")
SPOKEN_DOMAIN = re.compile(rf"[a-z0-9-]++(?:(?:\.|{SAID})[a-z0-9-]++)++")
#: A label and a spoken dot at the end of a stretch; local parts have at most 64 characters by the mail standard.
BEFORE = re.compile(rf"[a-z0-9._%+-]{{1,64}}({SAID})\Z")
BEFORE_MOST = 64 + 3 + max(map(len, DOT_WORDS)) + 3


@lru_cache(1)
def characters() -> tuple[np.ndarray, dict[str, str]]:
    """What single characters become: whatever Unicode calls compatible with one ASCII character, decimal digits, look-alikes; invisible ones nothing.

    Also which code points these are, as a table of booleans.
    """
    table = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " <= plain <= "~":
            table[c] = plain
        elif (digit := unicodedata.decimal(c, None)) is not None:
            table[c] = str(digit)
    for odd, plain in LOOKALIKES.values():
        table |= dict(zip(odd, plain, strict=True))
    table |= dict.fromkeys(INVISIBLE, "")
    known = np.zeros(0x110000, bool)
    known[list(map(ord, table))] = True
    return known, table


#: Code points that are looked at together.
STRETCH = 1 << 20


def character_edits(r: Rewritten) -> list[tuple[int, int, str]]:
    if r.text.isascii():
        return []
    known, table = characters()
    edits = []
    for at in range(0, len(r.text), STRETCH):
        points = np.frombuffer(r.text[at : at + STRETCH].encode("utf-32-le"), "<u4")
        edits += [(i, i + 1, table[r.text[i]]) for i in (np.flatnonzero(known[points]) + at).tolist()]
    return edits


def digit_edits(r: Rewritten) -> list[tuple[int, int, str]]:
    """Spelled digits with one or two separators to another one become digits; between them a comma with a space becomes a space."""
    edits: list[tuple[int, int, str]] = []
    t, before = r.low, None
    for m in SPELLED.finditer(t):
        start, end = m.span()
        if before and start - before[1] in (1, 2) and not (gap := t[before[1] : start]).strip(" ,.-"):
            if not edits or edits[-1][1] != before[1]:
                edits.append((*before, VALUE[t[before[0] : before[1]]]))
            if gap == ", ":
                edits.append((before[1], start, " "))
            edits.append((start, end, VALUE[m.group()]))
        before = (start, end)
    return edits


def letter_edits(r: Rewritten) -> list[tuple[int, int, str]]:
    return [(m.end() - 1, m.end(), "0" if m.group()[1] in "Oo" else "1") for m in AMONG.finditer(r.text)]


def plus_edits(r: Rewritten) -> list[tuple[int, int, str]]:
    return [(*m.span(), "+") for m in PLUS.finditer(r.low)]


def bracket_edits(r: Rewritten) -> list[tuple[int, int, str]]:
    """Bracketed signs and words between two parts of an address, with up to three spaces on either side."""
    edits, t, last = [], r.low, 0
    for m in BRACKETED.finditer(t):
        start, end = m.span()
        while start > max(last, m.start() - 3) and t[start - 1].isspace():
            start -= 1
        while end < min(len(t), m.end() + 3) and t[end].isspace():
            end += 1
        if start > last and end < len(t) and t[start - 1] in LOCAL and t[end] in LOCAL:
            word = m.group(1)
            edits.append((start, end, "@" if word == "@" or word in AT_WORDS else "."))
            last = end
    return edits


def spoken_edits(r: Rewritten) -> list[tuple[int, int, str]]:
    """Spoken dots between numbers; "at" between words where a domain follows that was disguised too, with the spoken dots on both its sides.

    Words for @ that mean nothing else need no disguised domain.  After a plain @ spoken dots count where no plain one follows.
    """
    t = r.low
    edits = [(*m.span(1), ".") for m in AMONG_NUMBERS.finditer(t)]
    last = 0
    for m in sorted([*SPOKEN_AT.finditer(t), *re.finditer("@", t)], key=lambda m: m.start()):
        start, end = m.span()
        while start > max(last, m.start() - 2) and t[start - 1].isspace():
            start -= 1
        while end < min(len(t), m.end() + 2) and t[end].isspace():
            end += 1
        if start <= last or t[start - 1] not in LOCAL or not (domain := SPOKEN_DOMAIN.match(t, end)):
            continue
        said = list(SPOKEN_DOT.finditer(t, *domain.span()))
        if m.group() == "@":
            if said and m.span() == (start, end) and "." not in t[domain.start() : said[0].start()]:
                edits += [(*d.span(), ".") for d in said]
            continue
        if not said and m.group(1) == "at" and (r.edited is None or not r.edited[domain.start() : domain.end()].any()):
            continue
        edits.append((start, end, "@"))
        while start > last and t[start - 1] in LOCAL:
            start -= 1
        while before := BEFORE.search(t, max(last, start - BEFORE_MOST), start):
            edits.append((*before.span(1), "."))
            start = before.start()
        edits += [(*d.span(), ".") for d in said]
        last = domain.end()
    return sorted(set(edits))


#: The chain, in its order.
CHAIN = (character_edits, letter_edits, digit_edits, plus_edits, bracket_edits, spoken_edits)


def beside_letter(text: str, start: int, end: int) -> bool:
    """Whether a letter of another script goes on where a span ends: then it is a part of a longer word."""
    return start > 0 and not text[start - 1].isascii() and text[start - 1].isalpha() or end < len(text) and not text[end].isascii() and text[end].isalpha()


def found_in(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is plain) by start, kind and end."""
    own = {kind: list(find(text)) for kind, find in FINDERS.items()}
    rewritten = Rewritten(text)
    for step in CHAIN:
        rewritten.apply(step(rewritten))
    spans = [(kind, s, e, True) for kind, at in own.items() for s, e in at]
    if rewritten.starts is not None:
        for kind, find in FINDERS.items():
            for s, e in find(rewritten.text):
                if not rewritten.edited[s:e].any() or beside_letter(rewritten.text, s, e):
                    continue
                start, end = rewritten.source(s, e)
                # a plain number that spelled ones happen to follow stays as it is; a plain address may be the end of a longer one
                if not any(a <= start and end <= b if kind == "email" else a < end and start < b for a, b in own[kind]):
                    spans.append((kind, start, end, False))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = "array<struct<kind:string,start:long,end:long,plain:boolean>>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (long) and spans (kind, start, end, plain) of each row's whole text; places in code points, the end exclusive.

    Null and empty texts have no spans.  Repeated rows and null ids stay; other columns are ignored.  Spans may
    overlap: those of different kinds, and an added one that holds a plain one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "plain"), x, strict=True)) for x in found_in(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, ARROW_SPAN)], ["id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id long, spans {SPAN}").select(F.col("id").alias(id_col), "spans")


def without_spans(text: str) -> str:
    """The text with each span, or group of overlapping ones, replaced by its first kind in angle brackets."""
    out, at = [], 0
    spans = found_in(text)
    i = 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += (text[at:start], f"<{kind}>")
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with personal data in the text replaced by <kind>; null texts stay null.  Columns of any names pass."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([None if t is None else without_spans(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, plain)

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def said(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are of plain identifiers, as base_sha256 is; n_added counts what the transducers add."""
    rows = detected(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    counts = [F.size(F.filter(plain["kind"], kind.__eq__)).cast("long").alias(f"n_{name}") for name, kind in ((k, F.lit(k)) for k in KINDS)]
    added = F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(F.encode(said(plain), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), added)
