"""Text units of files, by format, from the standard library alone.

A file becomes one or more units (page, slide, sheet or whole file) with a label.  A failure is a row with
success = false and a message, never a failed job.
"""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from pathlib import PurePath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import LONGEST, SHORTEST
from lodestone.session import ship

from . import simple_pdf

#: Elements whose text is not part of a page, those without an end tag, and the largest sheet of the format.
HIDDEN = {"script", "style", "head", "nav", "footer", "aside", "noscript", "meta", "link", "button", "form", "input"}
VOID = {"meta", "link", "input", "br", "hr", "img", "area", "base", "col", "embed", "source", "track", "wbr"}
SHEET_ROWS, SHEET_COLUMNS = 1 << 20, 1 << 14
HEADER_ROWS = 5
SNIFFED = 4096
DROPPED = dict.fromkeys(map(ord, "​‌‍﻿"))


class Unreadable(Exception):
    """Its message goes to the result."""


def normalised(text: str, indent: bool = False) -> str:
    text = unicodedata.normalize("NFC", text).replace(" ", " ").translate(DROPPED)
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    text = "\n".join(x.rstrip() if indent else x.strip() for x in lines)
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


def decoded(data: bytes) -> str:
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return re.sub(r"\r\n?", "\n", text)


class PageText(HTMLParser):
    def __init__(self, hidden: set[str]):
        super().__init__(convert_charrefs=True)
        self.hidden, self.depth, self.parts = hidden, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden and tag not in VOID:
            self.depth.append(tag)

    def handle_endtag(self, tag):
        if tag in self.depth:
            while self.depth.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def only_closed(text: str) -> str:
    """Escapes each ampersand that begins no reference, or one without its semicolon."""
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", text)


def page_text(html: str, hidden: set[str] = HIDDEN, closed: bool = False) -> str:
    """``closed``: references that lack their semicolon stay as they are; else those count too that the standard knows without it."""
    kept = only_closed if closed else str
    parser = PageText(hidden)
    parser.feed(kept(html))
    parser.close()
    return unescape(kept("\n".join(parser.parts)))


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


class Package:
    """A zip file of XML parts."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Unreadable(f"not a document package: {e}") from e
        self.names = self.zip.namelist()

    def xml(self, name: str):
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (KeyError, ElementTree.ParseError) as e:
            raise Unreadable(f"part {name} can't be read: {e}") from e

    def numbered(self, pattern: str) -> list[tuple[int, str]]:
        return sorted((int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n)))


def runs(node, tag: str = "t") -> str:
    """Text of all runs under a node, with tabs and breaks."""
    return "".join(x.text or "" if local(x.tag) == tag else "\t" if local(x.tag) == "tab" and tag == "t" else "\n" if local(x.tag) in ("br", "cr") else "" for x in node.iter())


def docx(data: bytes, name: str) -> list[tuple[str, str]]:
    package = Package(data)
    body = next((x for x in package.xml("word/document.xml") if local(x.tag) == "body"), None)
    if body is None:
        raise Unreadable("the document has no body")
    lines, tables = [], []
    for block in body:
        if local(block.tag) == "p":
            style = next((attribute(x, "val") or "" for x in block.iter() if local(x.tag) == "pStyle"), "")
            text = runs(block).strip()
            if text:
                level = re.search(r"heading\s*(\d*)", style, re.I)
                lines.append(f"[Heading {level[1] or 1}] {text}" if level else text)
        elif local(block.tag) == "tbl":
            tables.append(block)
    for i, table in enumerate(tables, 1):
        lines.append(f"[Table {i}]")
        lines += table_rows(table, "tr", "tc", runs)
    for part in [n for _, n in package.numbered(r"word/header(\d+)\.xml")] + [n for _, n in package.numbered(r"word/footer(\d+)\.xml")]:
        lines += filter(None, (runs(p).strip() for p in package.xml(part).iter() if local(p.tag) == "p"))
    return [(f"Document: {name}", "\n".join(lines))]


def table_rows(table, row: str, cell: str, text) -> list[str]:
    found = [[text(c).strip() for c in r.iter() if local(c.tag) == cell] for r in table.iter() if local(r.tag) == row]
    return [" | ".join(filter(None, cells)) for cells in found if any(cells)]


def open_text(node) -> str:
    """Text of an OpenDocument node, with its spaces and tabs."""
    out = [node.text or ""]
    for x in node:
        kind = local(x.tag)
        out.append(" " * int(attribute(x, "c") or 1) if kind == "s" else "\t" if kind == "tab" else "\n" if kind == "line-break" else open_text(x))
        out.append(x.tail or "")
    return "".join(out)


def odt(data: bytes, name: str) -> list[tuple[str, str]]:
    """In document order; each paragraph once."""
    lines, tables = [], 0

    def visit(node, prefix: str = ""):
        nonlocal tables
        for x in node:
            kind = local(x.tag)
            if kind == "h":
                lines.append(f"[Heading {attribute(x, 'outline-level') or 1}] {open_text(x).strip()}")
            elif kind == "p":
                if text := open_text(x).strip():
                    lines.append(prefix + text)
            elif kind == "table":
                tables += 1
                lines.append(f"[Table {tables}]")
                lines.extend(table_rows(x, "table-row", "table-cell", open_text))
            else:
                visit(x, "• " if kind == "list-item" else prefix)

    visit(Package(data).xml("content.xml"))
    return [(f"Document: {name}", "\n".join(lines))]


def paragraphs(node) -> list[str]:
    return [t for p in node.iter() if local(p.tag) == "p" and (t := runs(p).strip())]


def pptx(data: bytes, name: str) -> list[tuple[str, str]]:
    package, out = Package(data), []
    for n, part in package.numbered(r"ppt/slides/slide(\d+)\.xml"):
        title, lines = "", []
        for shape in (x for x in package.xml(part).iter() if local(x.tag) in ("sp", "tbl")):
            if local(shape.tag) == "tbl":
                lines += table_rows(shape, "tr", "tc", runs)
                continue
            kind = next((attribute(x, "type") for x in shape.iter() if local(x.tag) == "ph"), None)
            found = paragraphs(shape)
            if kind in ("title", "ctrTitle") and not title:
                title = " ".join(found)
            else:
                lines += found
        lines = [f"[Title] {title}"] * bool(title) + [x for x in lines if x != title]
        if (notes := f"ppt/notesSlides/notesSlide{n}.xml") in package.names:
            texts = [t for s in package.xml(notes).iter() if local(s.tag) == "sp" and any(attribute(x, "type") == "body" for x in s.iter() if local(x.tag) == "ph") for t in paragraphs(s)]
            lines += [f"[Notes] {' '.join(texts)}"] * bool(texts)
        out.append((f"Slide {n}", "\n".join(lines)))
    return out


def odp(data: bytes, name: str) -> list[tuple[str, str]]:
    out = []
    pages = [x for x in Package(data).xml("content.xml").iter() if local(x.tag) == "page"]
    for n, page in enumerate(pages, 1):
        lines, notes = [], []
        for part in page:
            texts = [t for p in part.iter() if local(p.tag) in ("p", "h") and (t := open_text(p).strip())]
            (notes if local(part.tag) == "notes" else lines).extend(texts)
        lines += [f"[Notes] {' '.join(notes)}"] * bool(notes)
        out.append((f"Slide {n}", "\n".join(lines)))
    return out


def filled(cell) -> str:
    return "" if cell is None else str(cell).strip()


def linearised(rows: list[list], names: list[str]) -> str:
    """``name: value | ...`` for each row with any value."""
    lines = (" | ".join(f"{h}: {v}" for h, c in zip(names, row, strict=False) if (v := filled(c))) for row in rows)
    return "\n".join(filter(None, lines))


def sheet_text(rows: list[list]) -> str:
    """The header is the fullest of the first rows, the first of equals; rows above it are no data."""
    counts = [sum(bool(filled(c)) for c in r) for r in rows[:HEADER_ROWS]]
    if not counts or not max(counts):
        return ""
    at = counts.index(max(counts))
    return linearised(rows[at + 1 :], [filled(c) or f"Col{i}" for i, c in enumerate(rows[at], 1)])


def column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx(data: bytes, name: str) -> list[tuple[str, str]]:
    package = Package(data)
    shared = [runs(x) for x in package.xml("xl/sharedStrings.xml") if local(x.tag) == "si"] if "xl/sharedStrings.xml" in package.names else []
    targets = {attribute(x, "Id"): attribute(x, "Target") for x in package.xml("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in (x for x in package.xml("xl/workbook.xml").iter() if local(x.tag) == "sheet"):
        target = targets.get(attribute(sheet, "id")) or ""
        rows = []
        for row in (x for x in package.xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter() if local(x.tag) == "row"):
            cells: list = []
            for c in (x for x in row if local(x.tag) == "c"):
                at = column_number(attribute(c, "r") or "") if attribute(c, "r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = next((x.text for x in c if local(x.tag) == "v"), None), attribute(c, "t")
                cells[at] = runs(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
            rows.append(cells)
        out.append((f"Sheet: {attribute(sheet, 'name')}", sheet_text(rows)))
    return out


def ods(data: bytes, name: str) -> list[tuple[str, str]]:
    """Row 1 is the header; cells that read "nan" count as empty.

    Cells and rows that stand for several are repeated, so values stay under their headers; empty cells at a row's end and empty rows go.
    """
    out = []
    for table in (x for x in Package(data).xml("content.xml").iter() if local(x.tag) == "table"):
        rows = []
        for row in (x for x in table.iter() if local(x.tag) == "table-row"):
            cells: list[str] = []
            blank = 0  # empty cells since the last filled one
            for c in (x for x in row if local(x.tag) in ("table-cell", "covered-table-cell")):
                text = "\n".join(open_text(p) for p in c if local(p.tag) == "p").strip()
                n = int(attribute(c, "number-columns-repeated") or 1)
                if not text or text.lower() == "nan":
                    blank += n
                else:
                    cells += [""] * min(blank, SHEET_COLUMNS) + [text] * min(n, SHEET_COLUMNS)
                    blank = 0
                if len(cells) > SHEET_COLUMNS:
                    raise Unreadable("a row has more cells than a sheet can hold")
            if cells:
                rows += [cells] * min(int(attribute(row, "number-rows-repeated") or 1), SHEET_ROWS - len(rows))
        width = max(map(len, rows), default=0)
        out.append((f"Sheet: {attribute(table, 'name')}", linearised(rows[1:], [c or f"Col{i}" for i, c in enumerate(rows[0] + [""] * (width - len(rows[0])), 1)]) if rows else ""))
    return out


def comma_file(data: bytes, name: str) -> list[tuple[str, str]]:
    """The delimiter is guessed from the beginning, and is a comma if the guess gives ragged or single columns."""
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:SNIFFED], ",;\t|")
        widths = [len(r) for _, r in zip(range(HEADER_ROWS), csv.reader(io.StringIO(text), dialect), strict=False)]
        if len(set(widths)) != 1 or widths[0] <= 1:
            dialect = csv.excel
    except csv.Error:
        dialect = csv.excel
    rows = list(csv.reader(io.StringIO(text), dialect))
    found = linearised(rows[1:], [c.strip() for c in rows[0]]) if rows else ""
    if not found:
        raise Unreadable("the table has no data rows")
    return [(f"CSV: {name}", found)]


def mail(data: bytes, name: str) -> list[tuple[str, str]]:
    """Plain text is preferred to HTML, whatever their order; HTML is stripped."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    lines = [f"{h}: {message[h]}" for h in ("Subject", "From", "To", "Date") if message[h]]
    body = message.get_body(("plain", "html"))
    text = ""
    if body is not None:
        try:
            text = body.get_content()
        except (LookupError, UnicodeError):
            text = (body.get_payload(decode=True) or b"").decode("utf-8", "replace")
        if body.get_content_type() == "text/html":
            text = page_text(text, {"script", "style"})
    attached = [a.get_filename() for a in message.iter_attachments() if a.get_filename()] if message.is_multipart() else []
    lines += ["", text] + [f"[Attachments] {', '.join(attached)}"] * bool(attached)
    return [(f"Email: {name}", "\n".join(lines))]


def pdf(data: bytes, name: str) -> list[tuple[str, str]]:
    """Pages by ``pypdf`` where it is installed, else by the reader of this package."""
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            return [(f"Page {n}", text) for n, text in enumerate(simple_pdf.pages(data), 1)]
        except simple_pdf.NotPdf as e:
            raise Unreadable(str(e)) from None
    try:
        reader = PdfReader(io.BytesIO(data))
    except Exception as e:
        raise Unreadable(f"the file can't be opened: {e}") from e
    if reader.is_encrypted:
        raise Unreadable("the file is encrypted")
    out = []
    for n, page in enumerate(reader.pages, 1):
        try:
            out.append((f"Page {n}", page.extract_text() or ""))
        except Exception:  # noqa: S112  a page that can't be read doesn't end the file
            continue
    return out


def old_sheets(data: bytes, name: str) -> list[tuple[str, str]]:
    try:
        import xlrd
    except ImportError:
        raise Unreadable("xlrd is not installed") from None
    book = xlrd.open_workbook(file_contents=data)
    out = []
    for sheet in book.sheets():
        rows = [sheet.row_values(i) for i in range(sheet.nrows)]
        out.append((f"Sheet: {sheet.name}", linearised(rows[1:], [filled(c) or f"Col{i}" for i, c in enumerate(rows[0], 1)]) if rows else ""))
    return out


def web(data: bytes, name: str) -> list[tuple[str, str]]:
    return [(f"HTML: {name}", page_text(decoded(data)))]


def plain(data: bytes, name: str) -> list[tuple[str, str]]:
    return [(f"File: {name}", decoded(data))]


BY_CATEGORY = {"plain_text": plain, "source_code": plain, "pdf": pdf, "word": docx, "presentation": pptx, "spreadsheet": xlsx, "email": mail, "web": web}
BY_EXTENSION = {".odt": odt, ".odp": odp, ".xls": old_sheets, ".ods": ods, ".csv": comma_file}


def extract(path: str, extension: str, category: str, data: bytes) -> dict:
    """One file: md5, success, error_message, units (text, source_label, char_count, word_count)."""
    units, problem = [], None
    reader = BY_EXTENSION.get(extension) or BY_CATEGORY.get(category)
    if reader is None:
        problem = f"no extractor for category {category}"
    else:
        try:
            for label, text in reader(data, PurePath(path).name):
                text = normalised(text, category == "source_code")[:LONGEST]
                if len(text) >= SHORTEST:
                    units.append({"text": text, "source_label": label, "char_count": len(text), "word_count": len(text.split())})
            if not units:
                problem = "Extraction produced zero chunks"
        except Unreadable as e:
            problem, units = str(e), []
        except Exception as e:
            problem, units = f"{type(e).__name__}: {e}", []
    return {"file_hash_md5": hashlib.md5(data).hexdigest(), "success": problem is None, "error_message": problem, "units": units}


UNITS = "array<struct<text: string, source_label: string, char_count: int, word_count: int>>"
SCHEMA = f"absolute_path string, relative_path string, extension string, format_category string, file_hash_md5 string, success boolean, error_message string, units {UNITS}"


def extracted(files: DataFrame) -> DataFrame:
    """A row for each of ``files`` (absolute_path, relative_path, extension, format_category), read by the task that extracts it."""
    ship(files.sparkSession)
    unit = pa.list_(pa.struct([("text", pa.string()), ("source_label", pa.string()), ("char_count", pa.int32()), ("word_count", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, _, extension, category = (b.column(j)[i].as_py() for j in range(4))
                try:
                    with open(path, "rb") as f:
                        found = extract(path, extension, category, f.read())
                except OSError as e:
                    found = {"file_hash_md5": "", "success": False, "error_message": str(e), "units": []}
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, 1) for c in b.columns), pa.array([found["file_hash_md5"]]), pa.array([found["success"]]), pa.array([found["error_message"]], pa.string()), pa.array([found["units"]], unit)],
                    [*b.schema.names, "file_hash_md5", "success", "error_message", "units"],
                )

    return files.select("absolute_path", "relative_path", "extension", "format_category").mapInArrow(run, SCHEMA)


def unit_rows(extractions: DataFrame, failed: bool = False) -> DataFrame:
    """One row for each unit of the successful files, with its place in the file.

    With ``failed`` a file that could not be read is one row too, with success = false, its message and no unit.
    """
    rows = extractions if failed else extractions.where("success")
    explode = F.posexplode_outer if failed else F.posexplode
    more = ["success", "error_message"] if failed else []
    return rows.select("relative_path", "absolute_path", "format_category", *more, explode("units").alias("source_chunk_index", "unit")).select(
        F.col("relative_path").alias("source_file"), "format_category", "source_chunk_index", "unit.source_label", "unit.text", *more
    )
