"""Personal data, centroid clustering and importance resampling against plain versions of the same rules."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import centroids, importance, pii

from .conftest import awkward, prose

# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    return {(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if sound(k, m.group())}


def base(text):
    return {(k, s, e) for k, s, e, plain in pii.found_in(text) if plain}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ %_()0123459é"), max_size=60))
def test_plain_identifiers(text):
    assert base(text) == plain_spans(text)


@pytest.mark.parametrize("text", [
    "a@b@c.com", "a.b@c..d", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111-1111 1111 x 4111  1111 1111 1111", "+1 (988) 555-2485 +12 +49-(0)30.1234567890", "x@y.z" * 50, "+1" + " (" * 50 + "2",
])
def test_plain_identifiers_by_hand(text):
    assert base(text) == plain_spans(text)


DISGUISED = [
    ("email", "john dot doe at example dot com"), ("email", "john [at] example [dot] com"), ("email", "jo(at)ex.org"), ("email", "jane{dot}roe{at}mail{dot}co{dot}uk"), ("email", "josé".replace("é", "e") + " arroba correo punto es"),
    ("email", "ехаmple.user@gmаil.com"), ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jo​hn@exam­ple.com"), ("email", "john@example dot com"), ("ip", "192 dot 168 dot 1 dot 17"), ("ip", "192[.]168[.]0[.]1"), ("ip", "１９２.168.0.1"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "four, one, one, one, one, one, one, one, one, one, one, one, one, one, one, one"), ("card", "4111–1111–1111–1111"), ("card", "４１１１ 1111 1111 1111"), ("card", "41ll 1111 1111 1111".replace("ll ", "l1 ")),
    ("phone", "plus one nine eight eight five five five two four eight five"), ("phone", "+1 (988) 555‑2485"), ("phone", "más uno nueve ocho ocho cinco cinco cinco dos cuatro ocho cinco"), ("phone", "+1 988 five five five two four eight five"),
]


@pytest.mark.parametrize("kind,said", DISGUISED)
def test_disguised_identifiers_map_back(kind, said):
    for ahead, behind in (("", ""), ("Write to ", ", he said."), ("é🙂日本 " + prose(1, 30) + "\n", "\n" + prose(2, 30))):
        found = pii.found_in(ahead + said + behind)
        assert (kind, len(ahead), len(ahead) + len(said), False) in found, (said, found)


@pytest.mark.parametrize("text", [
    "We arrived at the station. Look at example.com for more.", "One of the two, six or seven were at home.", "point 3 point 5 at noon", "почта@", "Un an, deux ans, trois quatre cinq", "at dot at dot", "+1 (848) 555-1373 Un an oule", "a + one two", "Meet at 5, at 6 or at 7 dot",
])
def test_clean_texts_get_nothing_added(text):
    assert all(plain for *_, plain in pii.found_in(text))


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000 + "@", "1" * 300_000, "1.." * 150_000, " " * 300_000 + "at", "a dot " * 40_000, "+1" + " " * 300_000, "one " * 60_000, "a at b dot " * 20_000, "[ at ] " * 40_000):
        assert not any(plain for *_, plain in pii.found_in(text))


def test_detected_and_redacted(spark, docs, no_docs):
    extra = docs.withColumn("spans", F.lit("own")).withColumn("id", F.lit("i")).withColumn("c0", F.lit(1)).unionByName(
        docs.limit(1).withColumn("text", F.lit("mail jo@ex.org now")).withColumn("doc_id", F.lit(99)).withColumn("spans", F.lit("own")).withColumn("id", F.lit("i")).withColumn("c0", F.lit(1)))
    got = pii.detected(extra).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in [*awkward(), (99, "")])
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}[99] == [("email", 5, 14, True)]
    clean = pii.redacted(extra)
    assert clean.schema == extra.schema
    rows = clean.where("doc_id = 99").collect()
    assert [(r["text"], r["spans"], r["id"], r["c0"]) for r in rows] == [("mail <email> now", "own", "i", 1)]
    assert clean.where("doc_id <> 99 OR doc_id IS NULL").select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty()
    assert pii.detected(no_docs).isEmpty() and pii.redacted(no_docs).isEmpty()


# importance resampling

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_crcs(text, least, most):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZ09é日-. \n"), max_size=80), st.integers(1, 3), st.integers(0, 4))
def test_runs_are_composed_from_word_crcs(text, least, more):
    crcs, n = importance.Words().features(text, least, least + more)
    assert crcs.tolist() == plain_crcs(text, least, least + more) and n == len(plain_words(text))


def test_shift_is_what_zero_bytes_do():
    for length in (0, 1, 2, 3, 31, 255, 4096, 70_001):
        crc = zlib.crc32(b"any word")
        assert int(importance.shifted(np.array([crc], np.uint32), np.array([length]))[0]) ^ zlib.crc32(bytes(length)) == zlib.crc32(b"any word" + bytes(length))


def test_texts_are_cut_at_spaces(monkeypatch):
    text = prose(3, 400)
    want = plain_crcs(text, 1, 3)
    monkeypatch.setattr(importance, "STRETCH", 64)
    assert importance.Words().features(text, 1, 3)[0].tolist() == want


def plain_draw(docs, target, least, most, buckets, percent):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(c % buckets for c in plain_crcs(text, least, most))
    for text in target:
        t.update(c % buckets for c in plain_crcs(text, least, most))
    a, b = sum(s.values()), sum(t.values())
    gain = {x: math.floor(1000 * math.log(float(t[x] + 1) * float(a + buckets) / (float(s[x] + 1) * float(b + buckets)))) for x in range(buckets)}
    rows = []
    for i, text in docs:
        own = plain_crcs(text, least, most)
        weight = sum(gain[c % buckets] for c in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize("run,percent", [((1, 1), 40), ((1, 3), 100), ((2, 2), 0)])
def test_resampled(spark, docs, run, percent):
    target = [prose(1, 30), None, "", prose(9, 50)]
    wide = docs.withColumn("weight", F.lit("own")).withColumn("id", F.lit("x")).withColumn("place", F.lit(1)).withColumn("rank", F.lit(2))
    got = importance.resampled(wide, spark.createDataFrame([(t,) for t in target], "text string"), run, 500, percent=percent)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(awkward(), target, *run, 500, percent)


def test_resampling_empty_tables(spark, docs, no_docs):
    assert importance.resampled(no_docs, docs).isEmpty()
    got = importance.resampled(docs, no_docs, percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(awkward(), [], 1, 1, importance.BUCKETS, 50)


# centroids


def plain_rounds(vectors, k, rounds, dim, scale=256):
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 63), min((1 << 63) - 1, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    own = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for left in range(rounds, -1, -1):
        near = [min((far(v, c), n) for n, c in enumerate(own)) for _, v in kept]
        if left:
            for n in range(len(own)):
                mine = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
                if mine:
                    own[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    most = (1 << 63) - 1
    near = [(min(d, most), n) for d, n in near]
    total = Counter()
    for d, n in near:
        total[n] += d
    every = min(sum(total.values()), most)
    return sorted(((i, n, d, min(total[n], most), every, hashlib.sha256(",".join(map(str, own[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


def made_vectors(kind, n=300, dim=6):
    r = random.Random(kind)
    if kind == "clusters":
        middle = [[r.uniform(-2, 2) for _ in range(dim)] for _ in range(8)]
        return [(i, [x + r.gauss(0, 0.03) for x in r.choice(middle)]) for i in range(n)]
    if kind == "ties":
        return [(i, [float(r.randint(0, 1)) / 256 for _ in range(dim)]) for i in range(n)]
    if kind == "hot":
        return [(i, [0.25] * dim if i % 3 else [r.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    rows = [(i, [r.uniform(-1, 1) for _ in range(dim)]) for i in range(60)]
    return rows + [(None, [0.5] * dim), (None, [0.5] * dim), (7, rows[7][1]), (900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [None] * dim), (905, [float("inf")] * dim), (906, [3e38] * dim), (907, [-3e38, 3e10] + [0.0] * (dim - 2))]


@pytest.mark.parametrize("kind", ["clusters", "ties", "hot", "odd"])
def test_clusters(spark, kind):
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in made_vectors(kind)]
    rows = spark.createDataFrame([(i, v, "own", 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, cluster string, id int, v int").repartition(3)
    got = centroids.clustered(rows, k=12, rounds=4, dim=6, block=40)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rounds(vectors, 12, 4, 6)


def test_few_vectors_and_none(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.1])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, centroids.clustered(rows, k=5, dim=2).collect()), key=repr) == plain_rounds([tuple(r) for r in rows.collect()], 5, 5, 2)
    assert centroids.clustered(rows.where("vec_id > 9"), dim=2).isEmpty()


def test_nodes_are_assigned_whole_and_centroids_pruned():
    """The tree does less than all pairs on clustered vectors, and the same."""
    points = np.array([[round(256 * x) for x in v] for _, v in made_vectors("clusters", 2000)])
    tree = centroids.Tree(points)
    own = points[:20].copy()
    whole, found = 0, np.zeros(len(points), int)
    for _, start, end, centroid, each in tree.assigned(own):
        whole += (end - start) * (each is None)
        found[tree.order[start:end]] = centroid if each is None else each
    assert found.tolist() == centroids.squared(points, own).argmin(1).tolist()
    assert whole > 0
    again = centroids.Tree.unpacked(tree.packed(), 6)
    assert all((getattr(again, n) == getattr(tree, n)).all() for n in ("points", "low", "high", "sums"))


# the query without SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pii_query(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = Counter()
    for i, t in docs:
        spans = sorted(plain_spans(t), key=lambda x: (x[1], pii.KINDS.index(x[0])))
        n = Counter(k for k, *_ in spans)
        want[i, *(n[k] for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()] += 1
    got = pii.query(spark, FOLDER).collect()
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in pii.KINDS), r["base_sha256"]) for r in got) == want
    for r in got:
        plain = r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
        assert len([s for s in r["spans"].split(",") if s]) == plain + r["n_added"]
