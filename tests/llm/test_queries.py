"""Every registered query over the smallest tables, against DuckDB, a library or brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
from lodestone.llm import bpe, registry, repair, tokens

from .test_dedup import plain_fingerprint, roots

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return [(i, t or "") for i, t in duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()]


def rows(spark, name):
    return [tuple(r) for r in __spark_entry__.queries()[name](spark, FOLDER).collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.select(", ".join(got.columns)).fetchall())


def test_toxicity_query(spark, duck):
    got = rows(spark, "op1_toxicity")
    ids = [i for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()]
    assert sorted(r[0] for r in got) == sorted(ids)
    for i, held, score, predicted in got:
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.5)


def test_bpe_query(spark, texts):
    import base64

    import public_tokenizers

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in texts:
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(rows(spark, "op2_bpe")) == want


def test_simhash_query(spark, texts):
    prints = [plain_fingerprint(t) for _, t in texts]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(len(prints), near)
    assert Counter(rows(spark, "op3_simhash")) == Counter((i, f"{p:016x}", texts[r][0]) for (i, _), p, r in zip(texts, prints, root, strict=True))


def test_media_query(spark, texts):
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op6_media"](spark, FOLDER).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        data = t.encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_packing_query(spark, texts):
    whole = Tokenizer.from_file(tokens.WORD_BPE)
    want, total = Counter(), 0
    for i, t in texts:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[i, piece, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = __spark_entry__.queries()["op8_packing"](spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) <= -(-total // 2048) + 1 + len(held) // 50


def test_licenses_query(spark, duck, texts):
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op9_licenses"](spark, FOLDER).collect()}
    assert sorted(got) == sorted(i for i, _ in texts)
    families = {"GNU General Public License, version 3": "gpl", "under the MIT License": "mit", "Apache License, Version 2.0": "apache-2.0", "CC BY-NC 4.0": "cc-by-nc"}
    named = right = 0
    for i, t in texts:
        truth = {f for words, f in families.items() if words in t}
        found = set(filter(None, got[i]["families"].split(","))) & set(families.values())
        named += len(truth | found)
        right += len(truth & found)
    assert named and right >= 0.95 * named


def test_repair_query(spark, texts):
    whole = Tokenizer.from_file(tokens.BYTE_BPE)
    want, ahead = [], 0
    for i, t in texts:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, repair.END_ID], "<u4")
        want.append((i, ahead, len(ids), zlib.crc32(ids.tobytes())))
        ahead += len(ids)
    assert sorted(rows(spark, "op10_repair")) == want


def test_pipeline_query(spark, texts):
    got = __spark_entry__.queries()["pipeline"](spark, FOLDER).collect()
    assert 0 < len({r["doc_id"] for r in got}) < len(texts)
    held = defaultdict(int)
    for r in got:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048
