"""Small files of each format, made from a table's rows: what the scan and the extractors are tried on."""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.session import ship


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def pdf(text: str) -> bytes:
    shown = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    data = zlib.compress(b"BT /F1 12 Tf 72 700 Td (" + shown + b") Tj ET")
    parts = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [ 3 0 R ] /Count 1 >> endobj", b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj", b"4 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj" % (len(data), data), b"trailer << /Root 1 0 R >>\n%%EOF"]
    return b"\n".join(parts)


def mail(subject: str, text: str) -> bytes:
    m = EmailMessage()
    m["Subject"] = subject
    m.set_content(text)
    return m.as_bytes()


def made(kind: str, name: str, text: str) -> bytes:
    """A file with one paragraph, or for sheets one row under the header ``name``, ``text``."""
    n, t = escape(name), escape(text)
    cell = lambda x: f"<t:table-cell><t:p>{x}</t:p></t:table-cell>"
    inline = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'
    spaces = 'xmlns:o="o" xmlns:t="t" xmlns:d="d" xmlns:w="w" xmlns:p="p" xmlns:a="a" xmlns:r="r"'
    return {
        "txt": lambda: text.encode(),
        "html": lambda: f"<html><head><title>{n}</title></head><body><p>{t}</p></body></html>".encode(),
        "eml": lambda: mail(name, text),
        "pdf": lambda: pdf(text),
        "csv": lambda: f'name,text\n"{name}","{text}"\n'.encode(),
        "docx": lambda: package({"word/document.xml": f"<w:document {spaces}><w:body><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:body></w:document>"}),
        "odt": lambda: package({"content.xml": f"<o:doc {spaces}><o:text><t:p>{t}</t:p></o:text></o:doc>"}),
        "pptx": lambda: package({"ppt/slides/slide1.xml": f"<p:sld {spaces}><p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"}),
        "odp": lambda: package({"content.xml": f"<o:doc {spaces}><d:page><d:frame><t:p>{t}</t:p></d:frame></d:page></o:doc>"}),
        "xlsx": lambda: package({
            "xl/workbook.xml": f'<workbook {spaces}><sheets><sheet name="One" r:id="i1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{inline('A1', 'name')}{inline('B1', 'text')}</row><row>{inline('A2', n)}{inline('B2', t)}</row></sheetData></worksheet>",
        }),
        "ods": lambda: package({"content.xml": f'<o:doc {spaces}><t:table t:name="One"><t:table-row>{cell("name")}{cell("text")}</t:table-row><t:table-row>{cell(n)}{cell(t)}</t:table-row></t:table></o:doc>'}),
    }[kind]()


#: The formats that ``made`` knows, in natural order.
KINDS = ("txt", "html", "eml", "pdf", "csv", "docx", "odt", "pptx", "odp", "xlsx", "ods")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder on the shared file system, which goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared and not shared.startswith(("file:", "/")):
        raise ValueError("this needs a shared folder that is mounted on all machines")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    root = os.path.join(re.sub("^file:(//)?", "", shared), f"{tag}-{uuid.uuid4().hex}") if shared else tempfile.mkdtemp(prefix=f"lodestone-{tag}-")
    os.makedirs(root, exist_ok=True)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def tree(spark: SparkSession, rows: DataFrame) -> str:
    """A new directory tree on the shared file system, written by the tasks.  ``rows``: path (relative), kind (of KINDS, or "raw"), name, text."""
    ship(spark)
    root = scratch(spark, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(text.encode() if kind == "raw" else made(kind, name, text))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.select("path", "kind", "name", "text").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return root
