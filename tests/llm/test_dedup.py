"""SimHash groups, passages, neighbours, url rules and media, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import components, knn, media, simhash, substring, url_filter

from .conftest import awkward, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprint():
    for _, t in awkward():
        if len(t or "") < 5000:
            assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def family(rng, n, near):
    base = rng.integers(0, 1 << 63, n).astype(np.uint64)
    more = [base]
    for _ in range(near):
        flips = np.zeros(n, np.uint64)
        for _ in range(4):
            flips |= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        more.append(more[-1] ^ flips)
    return np.unique(np.concatenate(more))


@pytest.mark.parametrize("most", [1000, 30_000, 10_000_000])
def test_collisions_find_all(most):
    f = family(np.random.default_rng(3), 60, 3)
    away = np.zeros(len(f), np.int64)
    pairs = simhash.collisions(f, away, 64, 2, most)
    assert (np.bitwise_count(f[pairs[:, 0]] ^ f[pairs[:, 1]]) <= 4).all()
    true = [(i, j) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= 4]
    assert roots(len(f), pairs.tolist()) == roots(len(f), true)


@pytest.mark.parametrize(("distance", "most"), [(4, 2_000_000), (4, 5000), (3, 5000), (0, 5000)])
def test_links(spark, distance, most):
    f = family(np.random.default_rng(5), 40, 2)
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "fp long, node long")
    found = [(r["a"], r["b"]) for r in simhash.links(df, len(f), distance, most).collect()]
    true = [(i, j) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= distance]
    assert roots(len(f), found) == roots(len(f), true)


def test_crowded_parts(spark):
    # a dense family: hundreds of fingerprints that share nearly all bits, so that any part of first bits holds most of them
    rng = np.random.default_rng(12)
    base, loose = np.uint64(0x1234567890ABCDEF), family(rng, 30, 1)
    dense = np.full(400, base)
    for _ in range(3):
        dense ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    f = np.unique(np.concatenate([dense, loose]))
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "fp long, node long").persist()
    true = [(i, j) for i in range(len(f)) for j in range(i) if int(f[i] ^ f[j]).bit_count() <= 4]
    found = [(r["a"], r["b"]) for r in simhash.links(df, len(f), 4, 20_000, crowd=60).collect()]
    assert all(int(f[a] ^ f[b]).bit_count() <= 4 for a, b in found) and roots(len(f), found) == roots(len(f), true)
    sent = simhash.dealt(simhash.dealt(df, 6, 2), 8, 2)
    assert sent.select("depth").distinct().collect()[0][0] == 14
    one = {(r["part"], r["away"]) for r in sent.where(f"node = 0").collect()}
    head = int(f[0]) >> 50
    assert one == {(head ^ m, m.bit_count()) for m in range(1 << 14) if m.bit_count() <= 2}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 80, (60, 2))] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(300, pairs)
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    texts = awkward()
    f = [plain_fingerprint(t) if len(t or "") < 5000 else simhash.fingerprint(t) for _, t in texts]
    own = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    least = defaultdict(list)
    for (i, _), r in zip(texts, own, strict=True):
        least[r] += [] if i is None else [i]
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in rows) == Counter((i, x, min(least[r], default=None)) for (i, _), x, r in zip(texts, f, own, strict=True))
    assert simhash.near_duplicates(no_docs).count() == 0


def plain_removal(rows, k):
    """Kept words by row; rows with one id count as one document."""
    first, by = {}, sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for i, t in by:
        words = WORD.findall(t or "")
        for s in range(len(words) - k + 1):
            at = (-1 if i is None else i, s)
            key = tuple(words[s : s + k])
            first[key] = min(first.get(key, at), at)
    out = Counter()
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - k + 1):
            if first[tuple(words[s : s + k])] < (-1 if i is None else i, s):
                gone.update(range(s, s + k))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_passages(docs, no_docs, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    done = substring.without_repeats(docs)
    assert done.columns[: len(docs.columns)] == docs.columns
    rows = done.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans").collect()
    assert Counter(tuple(r)[:4] for r in rows) == plain_removal(awkward(), 20)
    for r in rows:
        for s in r["spans"]:
            assert s["words"] >= 20 and (s["source_doc"], s["source_start"]) < (substring.NO_ID if r["doc_id"] is None else r["doc_id"], s["start"])
    assert substring.without_repeats(no_docs).count() == 0


def test_sources_of_frequent_passages(spark, monkeypatch):
    passage = prose(77, 50)
    rows = awkward() + [(100 + i, f"{prose(300 + i, i % 5 + 3)} {passage} {prose(400 + i, 4)} {passage if i % 4 == 3 else ''}") for i in range(12)] + [(105, f"{prose(305, 3)} {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {}
    for doc, text in sorted(((substring.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows)):
        for s in range(len(text) - 19):
            w = tuple(text[s : s + 20])
            first[w] = min(first.get(w, (doc, s)), (doc, s))
    want = Counter()
    for i, t in rows:
        doc, words, spans = substring.NO_ID if i is None else i, (t or "").encode().split(), []
        for s in range(len(words) - 19):
            src = first[tuple(words[s : s + 20])]
            if src == (doc, s):
                continue
            if spans and spans[-1][0] + spans[-1][1] - 19 == s and (spans[-1][2], spans[-1][3] + s - spans[-1][0]) == src:
                spans[-1][1] += 1
            else:
                spans.append([s, 20, *src])
        want[i, tuple(map(tuple, spans))] += 1
    assert max(len(k[1]) for k in want) >= 2
    for hot in (4000, 2):
        monkeypatch.setattr(substring, "HOT", hot)
        got = substring.without_repeats(df).select("doc_id", "spans").collect()
        assert Counter((r[0], tuple(map(tuple, r[1]))) for r in got) == want, hot


def test_passages_at_random(spark):
    rng = np.random.default_rng(4)
    words = prose(9, 12).split()
    rows = [(int(i), " ".join(words[j] for j in rng.integers(0, 12, rng.integers(0, 60)) // rng.integers(1, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.without_repeats(df, k=5, m=2).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == plain_removal(rows, 5)


@pytest.mark.parametrize("bits", [1, 6])
def test_equal_hashes_of_other_words(spark, bits):
    # so few bits that windows of other words share a hash: only the comparison of words can tell
    shared = prose(50, 45)
    rows = [(i, f"{prose(600 + i, 30)} {shared if i % 3 else ''} {prose(700 + i, 25)}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = substring.without_repeats(df, bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == plain_removal(rows, 20)


def test_only_verified_spans_take_words(spark, monkeypatch):
    rows = [(i, prose(40, 60)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r["n_removed"] for r in substring.without_repeats(df).collect()) == 120
    spans = substring.spans
    monkeypatch.setattr(substring, "spans", lambda pieces: spans(pieces).where("doc <> 1"))
    assert {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(df).collect()} == {0: 0, 1: 0, 2: 60}
    # a source that holds other words ends the search, as its words are read
    monkeypatch.setattr(substring, "spans", lambda pieces: spans(pieces).withColumn("from_start", F.col("from_start") + 1).withColumn("n", F.col("n") - 1))
    with pytest.raises(RuntimeError, match="equal hashes"):
        substring.without_repeats(df)


@pytest.mark.parametrize("hot", [1000, 2, 1])
def test_paths_break_where_the_graph_branches(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    a, b, c = prose(1, 60), prose(2, 40), prose(3, 40)
    rows = [(0, f"{a} {b}"), (1, f"{a} {b}"), (2, f"{a} {c}"), (3, f"{a} {c}"), (4, a)]
    own = spark.createDataFrame(rows, "doc long, text string").withColumn("row", F.xxhash64("text")).withColumn("key", F.xxhash64("doc", "row"))
    got = sorted((r["doc"], r["start"], r["n"], r["paths"], r["from_doc"], r["from_start"]) for r in substring.repeated_spans(own).collect())
    # a has 41 windows; b and c follow it over one branching node
    assert got == [(1, 0, 81, 2, 0, 0), (2, 0, 41, 1, 0, 0), (3, 0, 41, 1, 0, 0), (3, 41, 40, 1, 2, 41), (4, 0, 41, 1, 0, 0)]


def test_rows_that_share_an_id(spark):
    # texts under one id are one document; the smallest coordinate may be in any of them, in any order of the rows
    t = [prose(i, 70) for i in range(4)]
    rows = [(5, t[0]), (5, f"{prose(9, 7)} {t[0]}"), (5, t[0]), (None, t[1]), (None, f"{prose(8, 3)} {t[1]}"), (6, f"{t[1]} {t[0]}"), (6, f"{t[2]} {t[2]}"), (6, f"{t[2]} {t[2]}")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == plain_removal(rows, 20)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6)) + 4 * rng.integers(0, 5, (400, 1))
    x[50:150] = x[50]
    rows = [(i, [float(c) for c in v], 1, "v") for i, v in enumerate(x)] + [(400, None, 1, "v"), (401, [float("nan")] * 6, 1, "v"), (402, [None] * 6, 1, "v"), (None, [1.0] * 6, 1, "v"), (7, [float(c) for c in x[7]], 1, "v")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, v string")
    whole = knn.whole(df).persist()
    got = knn.top_k(whole, whole.where("vec_id % 20 = 0"), 10, block=50, query_block=4).collect()
    v = np.floor(np.vstack([x, x[7:8]]) * 1024)
    ids = np.array([*range(400), 7])
    want = set()
    for q in range(0, 400, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        want |= {(q, r, int(ids[i]), int(s[i])) for r, i in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want
    assert knn.top_k(whole.limit(0), whole, 3).count() == 0 and knn.top_k(whole, whole.limit(0), 3).count() == 0
    assert knn.top_k(whole.where("vec_id < 3"), whole.where("vec_id = 0"), 10).count() == 2


def test_repeated_query_id(spark):
    rows = [(i, [5, 5]) for i in (0, *range(10))]  # alike, so all in one block
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    got = knn.top_k(df, df.where("vec_id = 0").limit(1), 10).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(1, 10)) and sorted(r["rank"] for r in got) == list(range(1, 10))


@pytest.mark.parametrize("size", [1.0, 1e5, 1e6, 1e10, 1e300])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)) * size
    x[100:140] = x[100] * (1 + 2.0**-50 * rng.integers(0, 3, (40, 8)))  # scores a few units apart
    x[5] *= 1e-5
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = knn.whole(df).persist()
    got = knn.top_k(whole, whole.where("vec_id % 25 = 0"), 10, block=60, query_block=5).collect()
    top = (1 << 63) - 1
    v = [[max(-top - 1, min(top, int(np.floor(c * 1024)))) for c in row] for row in x]
    want = set()
    for q in range(0, 300, 25):
        score = [sum(a * b for a, b in zip(v[q], row, strict=True)) for row in v]
        order = sorted((-s, i) for i, s in enumerate(score) if i != q)[:10]
        want |= {(q, r, i, max(-top - 1, min(top, -s))) for r, (s, i) in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want
    with pytest.raises(ValueError, match="components"):
        knn.top_k(whole.union(whole.limit(1).selectExpr("vec_id", "slice(v, 1, 3)")), whole, 3)


def test_repeated_query_ids_in_the_bound(spark):
    # ids held by many rows near the queries, and the true neighbours farther off
    rng = np.random.default_rng(9)
    near, far = rng.integers(900, 1000, (60, 5)), rng.integers(0, 900, (200, 5))
    rows = [(i % 3 * 10, [int(c) for c in v]) for i, v in enumerate(near)] + [(1000 + i, [int(c) for c in v]) for i, v in enumerate(far)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").persist()
    got = sorted(map(tuple, knn.top_k(df, df.where("vec_id < 1000"), 10, block=30, query_block=7).collect()))
    own, lists = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = []
    for q in (0, 10, 20):
        found = {}
        for v in {tuple(v) for i, v in rows if i == q}:
            for j, s in enumerate((lists @ np.array(v)).tolist()):
                if own[j] != q:
                    found.setdefault((q, v), []).append((-s, int(own[j])))
        # distinct vectors under one query id are one query: the best rows of all of them
        merged = sorted(p for x in found.values() for p in sorted(x)[:10])[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(merged, 1)]
    assert got == sorted(want)


def test_query_groups():
    assert knn.grouped({0: {1, 2}, 1: {1, 2}, 2: {9}}, {0: 5, 1: 5, 2: 5}, 20) == [[0, 1], [2]]
    assert len(knn.grouped({0: {1}, 1: {1}}, {0: 15, 1: 15}, 20)) == 2


URLS = [
    "https://WWW.Example.com/en/x?y#z", "http://example.com/en/", "http://example.com/e", "http://notexample.com/en/x", "http://a.b.example.com/en/q", "http://xwww.example.com/en/q", "https://shop.net/es/a",
    "https://net/fr/", "ftp://net", "no scheme", "", None, "http://", "http://com/", "http://com", "http://x.org/a", "http://example.com:80/en/", "http://example.com./en/", "x://a\nb.net/es/\nq", "http://foo.NET/fr/?http://com/", "http://ÄB.com/ü",
    "http://example\0x.com/en/a", "http://a\0.example.com/en/a", "x://a.net\0/es/", "x://\1net/es/", "x://net\0a/fr/", "x://a\1.net/fr/", "http://..com/en/", "http://.net/es/", "http://net./es/", "x://EXAMPLE.COM/en/", "x://example.com/en\0/", "x://\0", "x://\2\1\0.net/es/",
]


def plain_verdict(url, rules):
    at = -1 if url is None else url.find("://")
    if at < 0:
        host = path = ""
    else:
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url[at + 3 :], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    rows = [(i, u, "host", "stack") for i, u in enumerate(URLS)] + [(None, URLS[0], "host", "stack"), (0, URLS[0], "host", "stack")]
    urls = spark.createDataFrame(rows, "page_id long, url string, host string, stack string")
    many = [("block" if i % 3 else "allow", "example.com", f"/{'en/' * (i % 2)}{i}") for i in range(0, 40)] + [("block", "com", "/en/x?"), ("allow", "com", "/en/x"), ("block", "com", "/e")]
    more = [*url_filter.RULES, ("block", "example\0x.com", "/en/"), ("block", "\1net", "/"), ("block", "b.example.com", "/"), ("allow", "org", "/a"), ("block", "x.org", "")]
    for rules in (url_filter.RULES, more, url_filter.RULES[:1], more + many):
        got = url_filter.judge(urls, url_filter.rules_table(spark, rules)).collect()
        assert Counter(map(tuple, got)) == Counter((i, *plain_verdict(u, rules)) for i, u, *_ in rows)
    assert url_filter.judge(urls.limit(0), url_filter.rules_table(spark)).count() == 0
    none = url_filter.judge(urls, url_filter.rules_table(spark).limit(0))
    assert none.count() == len(rows) and none.where("rule IS NOT NULL").count() == 0


def test_hot_label(spark):
    # a label with nearly all urls is dealt out by salts; its boundaries stay fewer than its urls
    rows = [(i, f"http://{'www.' if i % 3 else ''}example.com/{'en/' if i % 2 else ''}{i}") for i in range(400)] + [(i, u) for i, u in enumerate(URLS, 1000)]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    rules = url_filter.rules_table(spark, url_filter.RULES)
    labels = urls.select(url_filter.top_label(url_filter.host_and_path(F.col("url"))[0]).alias("part"))
    marks = url_filter.host_boundaries(rules).select("part")
    assert url_filter.hot_parts(labels, marks, 50) == {"com": 9}
    assert url_filter.hot_parts(labels, marks, 1)["com"] == 410 // 24
    got = url_filter.judge(urls, rules, salt_rows=50).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_verdict(u, url_filter.RULES)) for i, u in rows)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_media_payload(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(data) and len(payload) - len(data) <= 64
    assert media.from_media(media.to_media(payload)) == payload
    assert media.feature(payload) == media.feature(payload)


@pytest.mark.parametrize("span", [1000, 1 << 25])
def test_media_rows(spark, docs, no_docs, monkeypatch, span):
    monkeypatch.setattr(media, "RANGE", span)
    archives = media.write_archives(docs)
    spark.dataSource.register(media.ArchiveSource)
    rows = media.described(media.read_archives(archives)).collect()
    want = Counter()
    for i, t in awkward():
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    same = [tuple(r)[1:] for r in rows if r["doc_id"] in (1, 2)]
    assert same[0] == same[1]
    assert media.described(media.read_archives(media.write_archives(no_docs))).count() == 0


def test_damaged_member(tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("0", b"first member")
        z.writestr("1", b"other member")
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
    with open(path, "r+b") as f:
        assert media.member_at(f, infos[1]) == b"other member"
        f.seek(infos[0].header_offset + 40)
        f.write(b"?")
        f.flush()
        with pytest.raises(OSError):
            media.member_at(f, infos[0])
        assert media.member_at(f, infos[1]) == b"other member"


def test_clashing_columns(docs):
    """Columns with the names that operators use inside or add stay as they were; results have an operator's own columns once."""
    want = Counter((r["doc_id"], r["h"], r["fp"], r["start"], r["place"]) for r in docs.collect())
    plain = docs.select("doc_id", "text")
    done = substring.without_repeats(docs.drop("kept"))
    assert Counter((r["doc_id"], r["h"], r["fp"], r["start"], r["place"]) for r in done.collect()) == want
    own = ("n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, done.select("doc_id", *own).collect())) == Counter(map(tuple, substring.without_repeats(plain).select("doc_id", *own).collect()))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == Counter(map(tuple, simhash.near_duplicates(plain).collect()))
    described = lambda x: Counter(map(tuple, media.described(media.read_archives(media.write_archives(x))).drop("path").collect()))
    assert described(docs) == described(plain)
    whole = knn.whole(docs.selectExpr("doc_id AS vec_id", "array(score, 1D) AS embedding", "h AS cell", "start AS block"))
    assert knn.top_k(whole, whole.where("vec_id = 1"), 2).count() == 2
