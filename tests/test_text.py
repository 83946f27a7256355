import os
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import text as t
from lodestone.operators import chunking as c
from lodestone.sources.extract import normalised
from pyspark.sql import functions as F

SAMPLES = [
    "é a b​c‍﻿d", "a\r\nb\rc", "a\n\n\n\n\n\nb", "a\n\n\nb", "   indent\n    more \n", "", "ab", "\n\n x \t\n", "İ ß Σ", None,
]


@pytest.mark.parametrize("code", [False, True])
def test_normalise(spark, code):
    f = t.normalise_code if code else t.normalise
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r[0]: r[1] for r in df.select("i", f(F.col("s"))).collect()}
    assert got == {i: None if s is None else normalised(s, code) for i, s in enumerate(SAMPLES)}
    assert all(s is None or unicodedata.is_normalized("NFC", s) for s in got.values())


def test_decoding(spark):
    rows = [(bytearray(b"caf\xc3\xa9"),), (bytearray(b"\xef\xbb\xbfx"),), (bytearray(b"caf\xe9\r\n"),), (bytearray(b"\xc3\xa9\xe9"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(t.decoded(F.col("b"))).collect()]
    assert got == ["café", "x", "café\n", "Ã©é"]


def test_names_and_sizes(spark):
    df = spark.createDataFrame([("a/X.TXT", 0), (".env", 1023), ("a.tar.gz", 1536), ("a/b", 1 << 30), (".a.py", 1280)], "p string, n long")
    got = [tuple(r) for r in df.select(t.extension(F.col("p")), t.human_bytes(F.col("n"))).collect()]
    assert got == [(".txt", "0.0 B"), ("", "1023.0 B"), (".gz", "1.5 KB"), ("", "1.0 GB"), (".py", "1.2 KB")]


def test_sentences():
    assert c.sentences("Mr. Smith came. He left.") == ["Mr.", "Smith came.", "He left."]
    assert c.sentences("It was e.g. foo. Then bar") == ["It was e.g. foo.", "Then bar"]
    assert c.sentences("One. Été came.") == ["One. Été came."]
    assert c.sentences("First\n\nSecond\n\n\nthird") == ["First", "Second third"] or c.sentences("First\n\n\nthird") == ["First third"]
    assert c.sentences(" \n ") == []


def words(n, at=0):
    return " ".join(f"w{i}" for i in range(at, at + n))


def test_sentence_chunks():
    assert c.by_sentences(words(120)) == [words(120)]
    assert c.by_sentences(words(500)) == [words(500)]
    two = f"{words(100)}. B{words(50)}"
    first, second = c.by_sentences(two)
    assert first == f"{words(100)}." and second.startswith(" ".join(first.split()[-30:]))
    assert c.by_sentences(f"{words(20)}. B{words(110)}")[1].split()[0] == "Bw0"  # 20 words: too few to carry


def test_block_chunks():
    long = words(60)
    chunks = c.by_blocks(f"{long}\n\n{long}\n \n{long}")
    assert chunks == [f"{long}\n\n{long}", f"{' '.join(long.split()[-30:])}\n\n{long}"]
    assert c.by_rows(f"{long}\n\n{long}\n{long}") == [f"{long}\n{long}", long]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \nAB", max_size=400), st.integers(1, 20), st.integers(0, 25))
def test_chunk_invariants(text, size, overlap):
    s = c.Settings(size, overlap, 10)
    assert s.overlap < s.size
    for category in ("plain_text", "source_code", "spreadsheet"):
        plain = c.chunk_text(text, category, s, None)
        assert all(x.strip() for x in plain)
        assert not set(text.split()) - {w for x in plain for w in x.split()}
        for chunk in c.chunk_text(text, category, s):
            assert c.count_tokens(chunk) <= 10 or len(chunk.split()) == 1


def test_guard():
    assert c.guarded(["x" * 2000], 10) == ["x" * 2000]
    assert c.guarded([words(10)], c.count_tokens(words(10))) == [words(10)]
    pieces = c.guarded([words(100)], 40, 5)
    assert pieces[0].split()[-5:] == pieces[1].split()[:5] and pieces[-1].split()[-1] == "w99"
    with pytest.raises(ValueError):
        c.Settings(0)


def test_numbering_across_units(spark):
    rows = [("a", 0, "One. Two."), ("a", 1, " "), ("a", 2, "Three."), ("b", 0, None)]
    units = spark.createDataFrame(rows, "source_file string, unit int, text string")
    got = c.exploded(c.chunked(units, c.Settings(1, 0, 50)).drop("text"), ["source_file"], "unit").orderBy("source_file", "chunk_index").collect()
    assert [(r["source_file"], r["unit"], r["chunk_index"], r["chunk_text"]) for r in got] == [("a", 0, 0, "One."), ("a", 0, 1, "Two."), ("a", 2, 2, "Three.")]


def test_guard_by_sums_and_by_search():
    import random

    r = random.Random(4)
    for n in range(40):
        chunk = " ".join("x" * r.randint(1, 30) + r.choice(["", ".", "!?"]) for _ in range(r.randint(1, 300)))
        for limit, overlap in ((10, 3), (64, 30), (5, 0)):
            assert c.guarded([chunk], limit, overlap) == c.guarded([chunk], limit, overlap, lambda t: c.count_tokens(t))
    count = c.FileCounter("/opt/tokenizers/byte_bpe_50k.json")
    if os.path.exists(count.path):
        made = c.guarded(["some words of a longer text " * 40], 50, 5, count)
        assert len(made) > 3 and all(count(x) <= 50 for x in made)
