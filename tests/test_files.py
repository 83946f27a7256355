import hashlib
import json
import os
import struct
import time
import zipfile
from email.message import EmailMessage
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import incremental
from lodestone.operators.chunking import Settings
from lodestone.plans import retrieval
from lodestone.plans.config import IndexConfig
from lodestone.sources import extract, metadata, parts, scan, store, vectors_bin
from lodestone.streaming.reindex import CHUNKS, reindex, watch


def put(path, data=b"some text here"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ("a.txt", "_u.md", ".dot.txt", "X.TXT", ".env", "image.png", "sub/b.py", "sub/deep/c.cpp", ".hidden/d.txt", "node_modules/e.js"):
        put(root / name)
    put(root / "big.log", b"x" * 3000)
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root / "sub", root / "sub/deep/loop")
    os.symlink(root / "gone", root / "broken.txt")
    return root


def test_scan(spark, tree):
    log = {r["relative_path"]: r for r in scan.scan(spark, str(tree), max_file_size_mb=0.002).collect()}
    accepted = {k for k, r in log.items() if r["status"] == "accepted"}
    assert accepted == {"a.txt", "_u.md", ".dot.txt", "X.TXT", "sub/b.py", "sub/deep/c.cpp"}
    assert log["image.png"]["reason"] == "unsupported_extension:.png" and log[".env"]["reason"] == "unsupported_extension:"
    assert log["big.log"]["reason"].startswith("exceeds_size_limit") and log[".hidden"]["reason"] == "hidden_directory"
    assert log["node_modules"]["reason"] == "ignored_directory" and log["link.txt"]["reason"] == "symlink"
    assert log["X.TXT"]["extension"] == ".txt"


def test_scan_options(spark, tree):
    log = {r["relative_path"]: r["reason"] for r in scan.scan(spark, str(tree), follow_symlinks=True, include_hidden=True).collect()}
    assert log["link.txt"] == "duplicate_real_path" and log["broken.txt"] == "broken_or_circular_symlink" and log["sub/deep/loop"] == "symlink_cycle"
    assert log[".hidden/d.txt"] is None
    assert scan.files(scan.scan(spark, str(tree), max_files=2)).count() == 2
    assert len(list(scan.iter_files(spark, str(tree), ignore=["sub"]))) == 5
    with pytest.raises(FileNotFoundError):
        scan.scan(spark, str(tree / "none"))
    with pytest.raises(NotADirectoryError):
        scan.scan(spark, str(tree / "a.txt"))
    assert scan.is_supported(".PDF") and scan.format_category(".odt") == "word" and len(scan.supported_extensions()) == 22


def units(name, data):
    ext = os.path.splitext(name)[1]
    return extract.extract(name, ext, scan.CATEGORY_OF[ext], data)


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return path.read_bytes()


def test_plain_formats():
    got = units("x.txt", b"caf\xe9\r\nb")
    assert got["success"] and got["units"][0]["text"] == "café\nb" and got["units"][0]["source_label"] == "File: x.txt"
    assert not units("x.txt", b"ab")["success"]
    assert units("x.py", b"def f():\n    pass  \n")["units"][0]["text"] == "def f():\n    pass"
    html = b"<html><head><title>t</title></head><body><nav>n</nav><p>A &amp;amp; B<br>c</p><form>f<input>g</form><script>s()</script>end</body></html>"
    assert units("x.html", html)["units"][0]["text"] == "A & B\nc\nend"
    assert not units("x.pdf", b"<html>404</html>")["success"]
    assert not units("x.docx", b"no zip")["success"]


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_csv(d):
    text = f"name{d}age\nAnn{d}30\nBob{d}\n"
    assert units("x.csv", text.encode())["units"][0]["text"] == "name: Ann | age: 30\nname: Bob"


def test_csv_edges():
    for bad in (b"", b"name,age\n"):
        assert not units("x.csv", bad)["success"]
    assert units("x.csv", b"a,,c\n1,2,3\n4,5\n")["units"][0]["text"] == "a: 1 | : 2 | c: 3\na: 4 | : 5"
    assert units("x.csv", b"only\none\ntwo\n")["units"][0]["text"] == "only: one\nonly: two"


def test_mail():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hello", "a@x", "b@x"
    m.set_content("plain body")
    m.add_alternative("<p>html body</p>", subtype="html")
    m.add_attachment(b"z", maintype="application", subtype="zip", filename="z.zip")
    text = units("m.eml", m.as_bytes())["units"][0]["text"]
    assert text.startswith("Subject: Hello\nFrom: a@x\nTo: b@x") and "plain body" in text and "html body" not in text and text.endswith("[Attachments] z.zip")
    only = EmailMessage()
    only["Subject"] = "H"
    only.set_content("<style>x</style><p>html body</p>", subtype="html")
    assert units("m.eml", only.as_bytes())["units"][0]["text"] == "Subject: H\n\nhtml body"


def test_office(tmp_path):
    w = 'xmlns:w="w"'
    p = lambda t, s="": f"<w:p>{s and f'<w:pPr><w:pStyle w:val={s!r}/></w:pPr>'}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = f"<w:document {w}><w:body>{p('Top', 'Heading2')}{p('text')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>{p('after')}</w:body></w:document>"
    got = units("d.docx", package(tmp_path / "d", {"word/document.xml": body, "word/header1.xml": f"<w:hdr {w}>{p('head')}</w:hdr>"}))
    assert got["units"][0]["text"] == "[Heading 2] Top\ntext\nafter\n[Table 1]\na | b\nhead"
    a = 'xmlns:a="a" xmlns:p="p"'
    shape = lambda t, kind="": f"<p:sp>{kind and f'<p:nvPr><p:ph type={kind!r}/></p:nvPr>'}<p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slides = {"ppt/slides/slide2.xml": f"<p:sld {a}>{shape('two')}</p:sld>", "ppt/slides/slide1.xml": f"<p:sld {a}>{shape('x')}{shape('T', 'title')}</p:sld>", "ppt/notesSlides/notesSlide1.xml": f"<p:notes {a}>{shape('note', 'body')}</p:notes>"}
    assert [(u["source_label"], u["text"]) for u in units("s.pptx", package(tmp_path / "s", slides))["units"]] == [("Slide 1", "[Title] T\nx\n[Notes] note"), ("Slide 2", "two")]
    book = '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="i1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="i1" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>Report</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>5</v></c></row><row/></sheetData></worksheet>'
    shared = "<sst><si><t>name</t></si><si><t>Ann</t></si></sst>"
    got = units("b.xlsx", package(tmp_path / "b", {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared}))
    assert got["units"] == [{"text": "name: Ann | n: 5", "source_label": "Sheet: One", "char_count": 16, "word_count": 5}]
    o = 'xmlns:o="o" xmlns:t="t" xmlns:d="d"'
    odt = f'<o:doc {o}><o:text><t:h t:outline-level="1">Top</t:h><t:p>one<t:s/>two</t:p><t:list><t:list-item><t:p>item</t:p></t:list-item></t:list></o:text></o:doc>'
    assert units("d.odt", package(tmp_path / "o", {"content.xml": odt}))["units"][0]["text"] == "[Heading 1] Top\none two\n• item"
    odp = f'<o:doc {o}><d:page><d:frame><t:p>hello</t:p></d:frame><o:notes><t:p>memo</t:p></o:notes></d:page></o:doc>'
    assert units("d.odp", package(tmp_path / "p", {"content.xml": odp}))["units"][0]["text"] == "hello\n[Notes] memo"
    row = lambda *c: "<t:table-row>" + "".join(f"<t:table-cell><t:p>{x}</t:p></t:table-cell>" for x in c) + "</t:table-row>"
    ods = f'<o:doc {o}><t:table t:name="S">{row("a", "b")}{row("1", "NaN")}</t:table></o:doc>'
    assert units("d.ods", package(tmp_path / "q", {"content.xml": ods}))["units"][0]["text"] == "a: 1"


def test_sparse_sheet(tmp_path):
    o = 'xmlns:o="o" xmlns:t="t"'
    cell = lambda t="", n=1: f'<t:table-cell t:number-columns-repeated="{n}">{t and f"<t:p>{t}</t:p>"}</t:table-cell>'
    row = lambda *c, n=1: f'<t:table-row t:number-rows-repeated="{n}">{"".join(c)}</t:table-row>'
    rows = [row(cell("a"), cell("b"), cell("c"), cell("d"), cell("", 1020)), row(cell("", 1024), n=9), row(cell("1"), cell("", 2), cell("4"), cell("", 1020)), row(cell("7", 3), n=2), row(cell("", 1024), n=1_048_000)]
    got = units("x.ods", package(tmp_path / "x", {"content.xml": f'<o:doc {o}><t:table t:name="S">{"".join(rows)}</t:table></o:doc>'}))
    assert got["units"][0]["text"] == "a: 1 | d: 4\na: 7 | b: 7 | c: 7\na: 7 | b: 7 | c: 7"


def pdf_of(pages, more=b"", flate=True):
    """A small PDF: a content stream for each page, in a tree of two levels."""
    import zlib

    parts = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"3 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj"]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    parts.append(b"2 0 obj << /Type /Pages /Kids [ 4 0 R ] /Count %d >> endobj" % len(pages))
    parts.append(b"4 0 obj << /Type /Pages /Kids [ %s ] /Resources << /Font << /F1 3 0 R /F2 6 0 R >> >> >> endobj" % kids)
    for i, text in enumerate(pages):
        data = zlib.compress(text) if flate else text
        parts.append(b"%d 0 obj << /Type /Page /Parent 4 0 R /Contents %d 0 R >> endobj" % (10 + 2 * i, 11 + 2 * i))
        parts.append(b"%d 0 obj << /Length %d %s>> stream\n%s\nendstream endobj" % (11 + 2 * i, len(data), b"/Filter /FlateDecode " if flate else b"", data))
    return b"\n".join([*parts, more, b"trailer << /Root 1 0 R >>", b"%%EOF"])


@pytest.mark.parametrize("flate", [True, False])
def test_pdf(flate):
    two = b"BT /F1 12 Tf 72 700 Td (First \\(page\\)) Tj 0 -14 Td [(wi) -20 (de) -300 (gap) ] TJ T* (caf\\351) ' ET"
    got = units("x.pdf", pdf_of([two, b"", b"BT /F1 9 Tf 1 0 0 1 5 5 Tm <4869207468657265> Tj ET"], flate=flate))
    assert [(u["source_label"], u["text"]) for u in got["units"]] == [("Page 1", "First (page)\nwide gap\ncafé"), ("Page 3", "Hi there")]
    cmap = b"6 0 obj << /Type /Font /ToUnicode 7 0 R >> endobj\n7 0 obj << >> stream\n1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<65E5> <672C>] endbfrange\nendstream endobj"
    got = units("x.pdf", pdf_of([b"BT /F2 9 Tf <001000110012000300200021> Tj ET"], cmap, flate))
    assert got["units"][0]["text"] == "abc 日本"
    assert units("x.pdf", pdf_of([b""]))["error_message"] == "Extraction produced zero chunks"
    assert units("x.pdf", pdf_of([two], b"trailer << /Encrypt 9 0 R >>"))["error_message"] == "the file is encrypted"


def test_binary_file(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    x = np.random.default_rng(42).normal(size=(10, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "chunk_id long, vector array<float>")
    assert vectors_bin.write(df, path, 4) == 10 and os.path.getsize(path) == 8 + 160
    back = vectors_bin.read(spark, path, 4).orderBy("chunk_id").toPandas()
    assert np.array_equal(np.array(back["vector"].tolist(), np.float32), x)
    with pytest.raises(ValueError):
        vectors_bin.write(df.limit(0), path, 4)
    with pytest.raises(ValueError):
        vectors_bin.read(spark, path, 5)
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(ValueError):
        vectors_bin.read(spark, path)


def test_export(spark, tmp_path):
    rows = [(i, f"t{i}", f"f{i}", "l", "plain_text", 3, 5, 0, [1.0, float(i)]) for i in range(3)]
    df = spark.createDataFrame(rows, store.FIELDS + ", vector array<float>")
    folder = str(tmp_path / "e")
    assert store.export(df, folder, IndexConfig(dim=2)) == 3 and store.validate(spark, folder)
    back, config = store.import_(spark, folder)
    assert sorted(back.collect()) == sorted(df.select(*back.columns).collect()) and config.dim == 2
    assert store.export_stats(folder)["valid"] and store.export_stats(folder + "x") is None
    with open(f"{folder}/config.json", "w") as f:
        f.write("{")
    assert store.import_(spark, folder)[1] == IndexConfig(dim=2)
    with open(f"{folder}/metadata.json", "w") as f:
        json.dump([{"chunk_id": 0}], f)
    assert not store.validate(spark, folder)


def plain_export(rows):
    """The exchange form of (chunk_id, ..., vector) rows, by one process."""
    rows = sorted(rows)
    records = [dict(zip(store.NAMES, r[:-1], strict=True)) for r in rows]
    return struct.pack("<II", len(rows), len(rows[0][-1])) + np.array([r[-1] for r in rows], "<f4").tobytes(), json.dumps(records, indent=2, ensure_ascii=False).encode()


def test_many_tasks_write_and_read_the_exchange_form(spark, tmp_path, monkeypatch):
    odd = ['"quoted" \\ {', "line\n  {\nline\n  },\n", "é 日本 🙂", "", "  {", "\u2028 \x7f"]
    rows = [(i, odd[i % len(odd)] + str(i), f"f{i}", "l", "plain_text", 3, 5, i % 7, [float(i), -0.5, 0.0]) for i in range(1500)]
    df = spark.createDataFrame(rows, store.FIELDS + ", vector array<float>").repartition(7)
    folder = str(tmp_path / "e")
    monkeypatch.setattr(vectors_bin, "PART", 2000)
    monkeypatch.setattr(metadata, "BLOCK", 5000)
    assert store.export(df, folder, IndexConfig(dim=3)) == 1500
    vectors, records = plain_export(rows)
    assert (Path(folder) / "vectors.bin").read_bytes() == vectors and (Path(folder) / "metadata.json").read_bytes() == records
    assert sorted(os.listdir(folder)) == ["config.json", "metadata.json", "vectors.bin"]
    assert metadata.count(f"{folder}/metadata.json") == 1500
    # each record is in one range, wherever ranges end
    schema = df.select(*store.NAMES).schema
    for size in (1, 97, 4096, 10**9):
        if size > 1:
            reader = metadata.MetadataReader({"path": f"{folder}/metadata.json", "range": str(size)}, schema)
            assert len(reader.partitions()) == -(-len(records) // size)
            got = [r for p in reader.partitions() for r in reader.records(p)]
            assert got == json.loads(records)
    found = metadata.read(spark, f"{folder}/metadata.json", store.FIELDS)
    assert sorted(map(tuple, found.collect())) == sorted(r[:-1] for r in rows)
    back, _ = store.import_(spark, folder)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)
    # another form than the usual one is read too
    with open(f"{folder}/metadata.json", "w") as f:
        json.dump(json.loads(records), f)
    assert metadata.count(f"{folder}/metadata.json") == 1500 and store.read_metadata(spark, f"{folder}/metadata.json").count() == 1500


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    good = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "chunk_id long, vector array<float>")
    assert vectors_bin.write(good, path) == 50
    bad = good.unionByName(spark.createDataFrame([(50, [1.0])], good.schema))
    with pytest.raises(Exception, match="components"):
        vectors_bin.write(bad, path)
    with pytest.raises(Exception, match="bytes were written"):
        parts.write_parts(spark.createDataFrame([(8, b"1234")], "offset long, data binary"), path, 99, {0: b"12345678"})
    assert os.listdir(tmp_path) == ["v.bin"] and vectors_bin.read(spark, path, 2).count() == 50
    # ids that aren't positions are numbered in their order
    assert vectors_bin.write(good.where("chunk_id % 2 = 1").withColumn("vector", F.array(F.col("chunk_id").cast("float"))), path) == 25
    assert [r[0] for r in vectors_bin.read(spark, path, 1).orderBy("chunk_id").select("vector").collect()] == [[float(i)] for i in range(1, 50, 2)]


def test_incremental(spark):
    kind = "chunk_id long, source_file string, source_chunk_index int, chunk_index int, text string"
    old = spark.createDataFrame([(0, "a", 0, 0, "x"), (1, "a", 0, 1, "y"), (2, "b", 0, 0, "z"), (3, "c", 0, 0, "q")], kind)
    new = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "y"), ("b", 0, 0, "new"), ("d", 0, 0, "d")], kind.split(", ", 1)[1])
    assert {(r[0], r[2]): r[3] for r in incremental.diff(old, new).collect()} == {("a", 0): "unchanged", ("a", 1): "unchanged", ("b", 0): "changed", ("c", 0): "removed", ("d", 0): "added"}
    assert {(r["chunk_id"], r["source_file"]) for r in incremental.merge(old, new).collect()} == {(0, "a"), (1, "a"), (4, "b"), (5, "d")}
    changed, merged = incremental.appended(old, new, order=("source_file", "chunk_index"))
    assert {(r["source_file"], r["text"]) for r in changed.collect()} == {("a", "x"), ("b", "new"), ("d", "d")}  # several chunks under one key
    assert [r["chunk_id"] for r in merged.orderBy("chunk_id").collect()] == [0, 1, 2, 3, 4, 5, 6]


def test_null_keys_and_many_ranges(spark):
    kind = "chunk_id long, source_file string, source_chunk_index int, chunk_index int, text string"
    old = spark.createDataFrame([(0, None, 0, 0, "x"), (1, "a", None, 1, "y"), (2, "b", None, 0, None), (3, "c", 0, 0, "q")], kind)
    new = spark.createDataFrame([(None, 0, 0, "x"), ("a", None, 1, "changed"), ("b", None, 0, None), ("d", 0, 0, "d"), (None, 1, 0, "n")], kind.split(", ", 1)[1])
    got = {(r["chunk_id"], r["source_file"], r["source_chunk_index"], r["text"]) for r in incremental.merge(old, new).collect()}
    assert got == {(0, None, 0, "x"), (2, "b", None, None), (4, None, 1, "n"), (5, "a", None, "changed"), (6, "d", 0, "d")}
    changed, merged = incremental.appended(old, new, order=("source_file", "chunk_index"))
    assert {r["text"] for r in changed.collect()} == {"changed", "d", "n"} and merged.count() == 7
    rows = spark.range(5000).selectExpr("nullif(id * 7919 % 5000, 3) AS a", "CAST(id % 3 AS STRING) AS b").repartition(5)
    for range_rows in (1 << 20, 300):
        ids = incremental.numbered(rows, ["a", "b"], 10, "n", range_rows).orderBy("n").collect()
        assert [r["n"] for r in ids] == list(range(10, 5010)) and [r["a"] for r in ids] == [None, *(x for x in range(5000) if x != 3)]


def test_index_and_search(spark, tree, tmp_path, capsys):
    folder, config = str(tmp_path / "index"), IndexConfig(dim=32)
    put(tree / "cats.txt", "Cats purr and sleep. They chase mice.")
    retrieval.index(spark, str(tree), folder, config)
    top = retrieval.search(spark, folder, "cats purr", 2).collect()
    assert top[0]["source_file"] == "cats.txt" and top[0]["rank"] == 1 and 0 < top[0]["score"] <= 1.0001
    assert retrieval.search(spark, folder, ["cats purr", "text"], 1, exact=True).count() == 2
    before = {r["source_file"]: r["chunk_id"] for r in store.load(spark, folder)[0].collect()}
    put(tree / "dogs.txt", "Dogs bark loudly.")
    os.unlink(tree / "a.txt")
    retrieval.index(spark, str(tree), folder, config)
    after = {r["source_file"]: r["chunk_id"] for r in store.load(spark, folder)[0].collect()}
    assert "a.txt" not in after and after["dogs.txt"] > max(before.values()) and after["cats.txt"] == before["cats.txt"]
    assert cli.main(["search", folder, "dogs bark", "-k", "1"], spark) == 0 and "dogs.txt" in capsys.readouterr().out
    assert cli.main(["search", str(tmp_path / "none"), "x"], spark) == 1 and "[ERROR] No index found" in capsys.readouterr().err
    assert cli.main(["scan", str(tree)], spark) == 0


def test_index_from_the_command_line(spark, tree, tmp_path, capsys):
    folder, out, back = (str(tmp_path / n) for n in ("index", "exchange", "back"))
    put(tree / "bad.docx", b"no zip")
    assert cli.main(["index", str(tree), folder, "--dim", "16"], spark) == 0
    capsys.readouterr()
    assert cli.main(["stats", folder], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["rows"] == found["chunks"] == 7 and found["dim"] == 16 and found["graph"] and found["shards"] == 1
    assert cli.main(["validate", folder], spark) == 0
    assert cli.main(["export", folder, out], spark) == 0 and cli.main(["validate", out], spark) == 0
    assert cli.main(["import", out, back], spark) == 0 and cli.main(["validate", back], spark) == 0
    capsys.readouterr()
    assert cli.main(["stats", out], spark) == 0 and json.loads(capsys.readouterr().out)["valid"]
    assert cli.main(["stats", str(tmp_path / "none")], spark) == 1 and cli.main(["validate", str(tmp_path / "none")], spark) == 1
    assert cli.main(["chunk", str(tree)], spark) == 0 and "not a zip" in capsys.readouterr().out.lower()
    capsys.readouterr()
    assert cli.main(["embed", "some words", "--dim", "8"], spark) == 0 and len(json.loads(capsys.readouterr().out)) == 8
    # an index whose manifest says other than its table
    entry = store.manifest(folder)
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump(entry | {"rows": 99}, f)
    assert not store.validate(spark, folder)


def test_index_by_a_path_with_a_scheme(spark, tree, tmp_path):
    folder, config = f"file://{tmp_path}/far", IndexConfig(dim=16)
    assert not store.index_exists(folder)
    with pytest.raises(store.NoIndex):
        store.load(spark, folder)
    for _ in range(2):  # the second manifest takes the first one's place
        retrieval.index(spark, str(tree), folder, config)
    assert store.index_exists(folder) and store.validate(spark, folder) and store.manifest(folder)["rows"] == 7
    assert retrieval.search(spark, folder, "some text", 2).count() == 2
    assert not [n for n in os.listdir(tmp_path / "far") if n.startswith(("staged", "manifest.json."))]


def test_failed_files_stay_visible(spark, tree):
    from lodestone.operators.summaries import run_totals

    put(tree / "bad.docx", b"no zip")
    put(tree / "short.txt", b"ab")
    put(tree / "blank.csv", b"")
    documents = retrieval.ingest(spark, str(tree)).documents().persist()
    rows = {r["source_file"]: r for r in documents.collect()}
    assert {f for f, r in rows.items() if not r["success"]} == {"bad.docx", "short.txt", "blank.csv"} and all(rows[f]["error_message"] and not rows[f]["chunks"] for f in ("bad.docx", "short.txt", "blank.csv"))
    assert rows["a.txt"]["chunks"] == 1 and rows["a.txt"]["words"] == 3
    total = run_totals(documents).first()
    assert total["documents"] == len(rows) and total["failed"] == 3 and total["total_words"] == sum(r["words"] for r in rows.values())


def test_bounds_are_found_by_halving(spark):
    rows = spark.range(-3, 40).select("id", F.struct("id", F.lit("x").alias("s")).alias("k"))
    for n in (1, 2, 3, 7, 8, 9, 16):
        bounds = F.array(*[F.struct(F.lit(2 * i).cast("long").alias("id"), F.lit("x").alias("s")) for i in range(n)])
        got = rows.select("id", incremental.count_up_to(bounds, F.col("k"), n).alias("n")).collect()
        assert [(r["id"], r["n"]) for r in got] == [(i, sum(2 * j <= i for j in range(n))) for i in range(-3, 40)]


def index_state(spark, folder):
    entry = store.manifest(folder)
    return entry, {r["chunk_id"]: (r["source_file"], r["text"]) for r in store.table_of(spark, folder, entry).collect()}


def size_of(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_graph_follows_the_index(spark, tree, tmp_path):
    folder, config = str(tmp_path / "ix"), IndexConfig(dim=128)
    retrieval.index(spark, str(tree), folder, config)
    before, had = index_state(spark, folder)
    put(tree / "new.txt", "Another text altogether.")
    retrieval.index(spark, str(tree), folder, config)
    after, has = index_state(spark, folder)
    assert had.items() <= has.items() and len(has) == len(had) + 1
    assert after["graph"]["entry"]["base"] == before["graph"]["entry"]["base"] and len(after["graph"]["entry"]["deltas"]) == 1
    os.unlink(tree / "a.txt")
    retrieval.index(spark, str(tree), folder, config)
    vectors, graph, _ = store.load(spark, folder)
    assert sorted(r[0] for r in graph.ids().collect()) == sorted(r[0] for r in vectors.select("chunk_id").collect())
    assert retrieval.search(spark, folder, "another text", 1).collect()[0]["source_file"] == "new.txt"
    assert {r["source_file"] for r in retrieval.search(spark, folder, "some text", 99).collect()} == {r["source_file"] for r in vectors.select("source_file").collect()}


def test_unchanged_files_are_not_opened(spark, tree, tmp_path):
    folder, config = str(tmp_path / "ix"), IndexConfig(dim=16)
    put(tree / "bad.docx", b"no zip")
    first = retrieval.index(spark, str(tree), folder, config)
    _, had = index_state(spark, folder)
    # other bytes, but neither size nor time tell: whoever opened the file would see it
    at = os.stat(tree / "a.txt")
    put(tree / "a.txt", (tree / "a.txt").read_bytes()[::-1])
    os.utime(tree / "a.txt", ns=(at.st_atime_ns, at.st_mtime_ns))
    assert retrieval.index(spark, str(tree), folder, config) == first
    put(tree / "b2.txt", "A second text, which is new.")
    retrieval.index(spark, str(tree), folder, config)
    _, has = index_state(spark, folder)
    assert {k: has[k] for k in had} == had and len(has) == len(had) + 1
    ledger = {r["relative_path"]: r for r in store.ledger_of(spark, folder, store.manifest(folder)).collect()}
    assert not ledger["bad.docx"]["success"] and ledger["b2.txt"]["file_hash_md5"] == hashlib.md5(b"A second text, which is new.").hexdigest()
    # with other settings, or in full, all are
    retrieval.index(spark, str(tree), folder, config, Settings(50, 10))
    assert ("a.txt", (tree / "a.txt").read_text().strip()) in index_state(spark, folder)[1].values()
    os.unlink(tree / "bad.docx")
    now = retrieval.index(spark, str(tree), folder, config, Settings(50, 10))
    assert now["number"] == store.manifest(folder)["number"] and "bad.docx" not in {r[0] for r in store.ledger_of(spark, folder, now).select("relative_path").collect()}


def test_touched_files_keep_their_chunks(spark, tree, tmp_path):
    folder, config = str(tmp_path / "ix"), IndexConfig(dim=16)
    retrieval.index(spark, str(tree), folder, config)
    entry, had = index_state(spark, folder)
    os.utime(tree / "a.txt", (1, 1))
    after = retrieval.index(spark, str(tree), folder, config)
    assert index_state(spark, folder)[1] == had and after["segments"] == entry["segments"] and after["number"] == entry["number"] + 1


def rows_of(spark, first, n, dim=16, word="w"):
    return spark.range(first, first + n, 1, 2).select(
        F.col("id").alias("chunk_id"), F.concat(F.lit(word), F.col("id")).alias("text"), F.concat(F.lit("f"), F.floor(F.col("id") / 10)).alias("source_file"), F.lit("l").alias("source_label"), F.lit("plain_text").alias("format_category"),
        F.lit(1).alias("word_count"), F.lit(1).alias("token_count"), (F.col("id") % 10).cast("int").alias("source_chunk_index"), F.lit(0).alias("chunk_index"), F.array(*[F.randn(i).cast("float") for i in range(dim)]).alias("vector"))


def test_updates_write_what_they_change(spark, tmp_path):
    folder, config = str(tmp_path / "ix"), IndexConfig(dim=64)
    store.save(rows_of(spark, 0, 20_000, 64), folder, config)
    whole, entry = size_of(folder), store.manifest(folder)
    old = store.table_of(spark, folder, entry)
    after = store.extended(spark, folder, entry, rows_of(spark, 20_000, 200, 64), spark.range(0, 200).withColumnRenamed("id", "chunk_id"))
    assert size_of(folder) - whole < 0.03 * whole and after["rows"] == 20_000 and after["next_id"] == 20_200
    assert store.table_of(spark, folder, after).agg(F.min("chunk_id"), F.max("chunk_id"), F.count("*")).first() == (200, 20_199, 20_000)
    # who reads the version before still can, even while the next one is made
    assert old.count() == 20_000
    third = store.extended(spark, folder, after, rows_of(spark, 20_200, 10, 64), spark.range(0).withColumnRenamed("id", "chunk_id"))
    assert store.table_of(spark, folder, after).count() == 20_000 and third["rows"] == 20_010 and store.validate(spark, folder)
    # much is dead: all is written anew, and what only older versions need goes two versions later
    fourth = store.extended(spark, folder, third, rows_of(spark, 20_210, 1, 64), spark.range(200, 9000).withColumnRenamed("id", "chunk_id"))
    assert len(fourth["segments"]) == 1 and fourth["dead"] == [] and fourth["rows"] == 20_011 - 8800
    fifth = store.extended(spark, folder, fourth, rows_of(spark, 20_211, 1, 64), spark.range(0).withColumnRenamed("id", "chunk_id"))
    assert {n for n in os.listdir(folder) if n.startswith(("s-", "x-"))} == {*fourth["segments"], *fifth["segments"]} and store.validate(spark, folder)


def test_two_writers(spark, tmp_path):
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        base = store.save(rows_of(spark, 0, 20), folder, IndexConfig(dim=16))
        none = spark.range(0).withColumnRenamed("id", "chunk_id")
        first = store.extended(spark, folder, base, rows_of(spark, 20, 5), none)
        with pytest.raises(store.Conflict):
            store.extended(spark, folder, base, rows_of(spark, 20, 7), none)
        assert store.manifest(folder) == first and store.load(spark, folder)[0].count() == 25
    # a writer that made its version but didn't come to say so
    with open(tmp_path / "a/manifest.json", "w") as f:
        json.dump(base, f)
    assert store.manifest(str(tmp_path / "a"))["rows"] == 25


def test_import_then_index(spark, tree, tmp_path):
    folder, out, back = (str(tmp_path / n) for n in ("index", "exchange", "back"))
    put(tree / "long.txt", " ".join(f"word{i}" for i in range(300)))
    retrieval.index(spark, str(tree), folder, IndexConfig(dim=16))
    assert cli.main(["export", folder, out], spark) == 0 and cli.main(["import", out, back], spark) == 0
    had = index_state(spark, back)[1]
    assert len([1 for f, _ in had.values() if f == "long.txt"]) >= 3 and had == index_state(spark, folder)[1]
    retrieval.index(spark, str(tree), back)
    assert index_state(spark, back)[1] == had


def test_merge_of_repeated_keys(spark):
    kind = "chunk_id long, source_file string, source_chunk_index int, chunk_index int, text string"
    old = spark.createDataFrame([(0, "a", 0, 0, "x"), (3, "a", 0, 0, "x"), (4, "a", 0, 0, "y"), (5, None, 0, 0, "n")], kind)
    new = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 0, "x"), (None, 0, 0, "n"), ("b", 0, 0, "z")], kind.split(", ", 1)[1])
    got = sorted((r["chunk_id"], r["source_file"], r["text"]) for r in incremental.merge(old, new).collect())
    assert got == [(0, "a", "x"), (5, None, "n"), (6, "a", "x"), (7, "b", "z")]


def test_parts_of_a_tree(spark, tree, monkeypatch):
    whole = sorted(map(tuple, scan.scan(spark, str(tree), follow_symlinks=True, include_hidden=True).collect()), key=repr)
    for parts in (1, 3):
        reader = scan.ScanReader({"path": str(tree), "follow_symlinks": "true", "include_hidden": "true"})
        monkeypatch.setattr(scan, "PARTS", parts)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted((r[1] for r in rows)) == sorted(r[1] for r in whole)
    for i in range(5):
        put(tree / f"one/d{i}/x.txt")
    monkeypatch.setattr(scan, "PARTS", 8)
    assert len(scan.ScanReader({"path": str(tree)}).partitions()) >= 8


def test_stream(spark, tmp_path):
    config, put_ = IndexConfig(dim=16), lambda n, rows: spark.createDataFrame(rows, CHUNKS).write.parquet(str(tmp_path / "in" / n))
    run = lambda: reindex(spark, str(tmp_path / "in/*"), str(tmp_path / "ix"), str(tmp_path / "cp"), config)
    put_("one", [("a", "l", "plain_text", 0, 0, "first", 1, 1), ("b", "l", "plain_text", 0, 0, "second", 1, 1)])
    run()
    put_("two", [("b", "l", "plain_text", 0, 0, "other", 1, 1)])
    run()
    rows = {r["source_file"]: r["text"] for r in store.load(spark, str(tmp_path / "ix"))[0].collect()}
    assert rows == {"a": "first", "b": "other"}
    vectors, graph, _ = store.load(spark, str(tmp_path / "ix"))
    assert graph.ids().exceptAll(vectors.select("chunk_id")).isEmpty() and graph.ids().count() == vectors.count()
    # two files of a batch with one chunk: the later one counts
    put_("x1", [("c", "l", "plain_text", 0, 0, "early", 1, 1)])
    put_("x2", [("c", "l", "plain_text", 0, 0, "late", 1, 1)])
    for name, at in (("x1", time.time() - 100), ("x2", time.time() - 50)):
        for f in (tmp_path / "in" / name).glob("*.parquet"):
            os.utime(f, (at, at))
    run()
    assert {r["source_file"]: r["text"] for r in store.load(spark, str(tmp_path / "ix"))[0].collect()} == {"a": "first", "b": "other", "c": "late"}


def test_watch_a_tree(spark, tmp_path):
    root, folder = tmp_path / "tree", str(tmp_path / "ix")
    run = lambda: watch(spark, str(root), folder, str(tmp_path / "cp"), IndexConfig(dim=16)).awaitTermination()
    put(root / "a.txt", "The first text.")
    put(root / "sub/b.md", "The second text.")
    put(root / "no.bin", "not a text")
    time.sleep(1.1)
    run()
    entry, had = index_state(spark, folder)
    assert sorted(had.values()) == [("a.txt", "The first text."), ("sub/b.md", "The second text.")] and entry["graph"]
    put(root / "c.txt", "The third text.")
    put(root / "a.txt", "The first text, changed.")
    time.sleep(1.1)
    run()
    after, has = index_state(spark, folder)
    assert sorted(t for _, t in has.values()) == ["The first text, changed.", "The second text.", "The third text."]
    assert {k: v for k, v in has.items() if v[0] == "sub/b.md"} == {k: v for k, v in had.items() if v[0] == "sub/b.md"}
    run()
    assert index_state(spark, folder) == (after, has) and store.validate(spark, folder)
    # a batch holds what changed between its offsets
    reader = scan.ScanStream({"path": str(root)})
    names = lambda a, b: sorted(r[1] for p in reader.partitions({"changed": a}, {"changed": b}) for r in reader.read(p))
    at = max(os.stat(root / "sub/b.md").st_mtime_ns, os.stat(root / "sub/b.md").st_ctime_ns)
    assert names(0, at) == ["sub/b.md"] and names(at, time.time_ns()) == ["a.txt", "c.txt"] and names(time.time_ns(), time.time_ns()) == []


@pytest.mark.parametrize(("only", "where"), [
    ([("extension", "=", ".txt")], "extension = '.txt'"), ([("extension", "in", [".txt", ".cpp"])], "extension IN ('.txt', '.cpp')"), ([("format_category", "=", "source_code")], "format_category = 'source_code'"),
    ([("size_bytes", ">", 100), ("size_bytes", "<=", 3000)], "size_bytes > 100 AND size_bytes <= 3000"), ([("relative_path", "starts", "sub/")], "relative_path LIKE 'sub/%'"), ([("relative_path", "starts", "sub/de")], "relative_path LIKE 'sub/de%'"),
    ([("relative_path", "=", "sub/deep/c.cpp")], "relative_path = 'sub/deep/c.cpp'"), ([("relative_path", "starts", "nothing")], "false"), ([("status", "=", "accepted"), ("extension", "=", ".md")], "status = 'accepted' AND extension = '.md'"), ([("reason", "starts", "unsupported")], "reason LIKE 'unsupported%'"), ([], "true"),
])
def test_conditions_reach_the_walk(spark, tree, only, where):
    whole = scan.scan(spark, str(tree), max_file_size_mb=0.002)
    assert sorted(map(repr, scan.scan(spark, str(tree), only=only, max_file_size_mb=0.002).collect())) == sorted(map(repr, whole.where(where).collect()))


def test_directories_stay_shut(spark, tree, monkeypatch):
    opened, looked = [], []
    listed, stat = os.scandir, os.stat
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, tree)) or listed(p))
    for i in range(20):
        put(tree / f"one/d{i}/x.txt")

    def run(*only):
        opened.clear()
        reader = scan.ScanReader({"path": str(tree), "wanted": json.dumps(only)})
        return [r[1] for p in reader.partitions() for r in reader.read(p)]

    assert run(("relative_path", "starts", "one/d7/")) == ["one/d7/x.txt"]
    assert {p for p in opened if p.startswith("one/")} == {"one/d7"} and "sub" not in opened
    assert run(("relative_path", "=", "sub/b.py")) == ["sub/b.py"] and not any(p.startswith("one/") for p in opened)
    # a name of the wrong kind is not looked at
    monkeypatch.setattr(os, "stat", lambda p, *a, **k: looked.append(str(p)) or stat(p, *a, **k))
    assert run(("extension", "=", ".cpp")) == ["sub/deep/c.cpp"]
    assert [p for p in looked if p.endswith((".txt", ".py", ".log"))] == []
    for bad in (("nothing", "=", 1), ("extension", "like", "x")):
        with pytest.raises(ValueError):
            run(bad)


def test_row_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v.bin")
    vectors_bin.write(spark.range(1000).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float")).alias("vector")), path)
    rows = lambda *only: vectors_bin.read(spark, path, only=only)
    for only, want in (
        ([(">=", 10), ("<", 13)], [10, 11, 12]), ([(">", 997)], [998, 999]), ([("=", 5)], [5]), ([("in", [3, 700])], [3, 700]), ([("<=", 1)], [0, 1]), ([(">", 5), ("<", 3)], []), ([("=", 2000)], []), ([("in", [])], []),
    ):
        assert sorted((r[0], r[1]) for r in rows(*[("chunk_id", *c) for c in only]).collect()) == [(i, [float(i)]) for i in want], only
    few, last = rows(("chunk_id", "<", 5)), rows(("chunk_id", ">=", 990))
    assert few.union(last).count() == 15 and few.count() == 5 and rows().count() == 1000
    monkeypatch.setattr(vectors_bin, "ROWS", 100)
    reader = vectors_bin.VectorReader({"path": path, "wanted": json.dumps([("chunk_id", ">=", 150), ("chunk_id", "<", 420)])})
    assert [(p.begin, p.end) for p in reader.partitions()] == [(150, 250), (250, 350), (350, 420)]
