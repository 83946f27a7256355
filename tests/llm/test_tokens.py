"""BPE, token files and packing, against the libraries and brute force."""

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing, repair, tokens

from .conftest import awkward, prose

ODD = st.text(alphabet=" \t\n\r\x0b\x1c\x1f\x85\xa0\u2009\u200b\u3000aAzé'sltmdv019½२.,!\u0301日🙂ñßİΣς\u180e", max_size=40)


#: Texts with the vocabularies' own tokens, which the libraries find as they are loaded, and with things much like them.
SPECIAL = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "<|endoftext|> y", "<|endoftext|><|endoftext|>", " <|startoftext|>  b<|endoftext|>\n", "<|startoftext|>é <|ENDOFTEXT|>", "<|endoftext|", "< |endoftext|>", "one <|endoftext|>two  \n three",
]


@pytest.fixture(scope="module")
def library():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    keys = np.unique(keys)
    h = bpe.PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    assert len(h(np.zeros(0, np.uint64))) == 0
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([3, 3], np.uint64))


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_bpe_is_the_library(library, text):
    own = bpe.coder(bpe.VOCABULARY)
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_rows(docs, no_docs, library):
    rows = bpe.decoded(bpe.encoded(docs)).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in awkward())
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows) == want
    assert bpe.decoded(bpe.encoded(no_docs)).count() == 0


@pytest.mark.parametrize(("path", "keeps"), [(tokens.WORD_BPE, False), (tokens.BYTE_BPE, True)])
def test_memo_is_the_library(path, keeps):
    r = random.Random(2)
    alphabet = " \t\n\x0b\x1c\x85\xa0\u3000aAzéÉÖßıǅ'sltmdv019½.,!:;?\u0301日🙂İΣς"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [t or "" for _, t in awkward()] + [chr(c) + "." for c in range(0xC0, 0x250)] + SPECIAL
    marks = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
    texts += ["".join(r.choice(["word", "Éa", " ", "s", "ll", "\n", "3"] + [r.choice(marks)] * 4) for _ in range(r.randint(1, 14))) for _ in range(4000)]
    own, whole = tokens.tokens(path, keeps), Tokenizer.from_file(path)
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    own.memo.limit = 1  # the memo is emptied between batches
    assert own.encode(texts[:50]) + own.encode(texts[50:]) == want
    own.memo.limit = 256 << 20


def test_a_word_is_encoded_once_whatever_marks_are_beside_it():
    own, whole = tokens.tokens.__wrapped__(tokens.BYTE_BPE, True), Tokenizer.from_file(tokens.BYTE_BPE)
    words = ["strana", "événement", "größere", "слово"]
    sides = ["", ",", ".", "\n", "(", "\n(", ").", "7", "'", "--", "...\n"]
    texts = [f"{a}{w}{b} {a}{w}{b}" for w in words for a in sides for b in sides]
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    held = [x if isinstance(x, str) else x.decode() for x in own.memo]
    for w in words:  # alone, after a space, and after an apostrophe with or without one
        assert {x for x in held if w in x} == {w, f" {w}", f"'{w}", f" '{w}"}


def test_cuts_beside_any_character_are_the_library_s():
    own, whole = tokens.tokens(tokens.BYTE_BPE, True), Tokenizer.from_file(tokens.BYTE_BPE)
    some = [*range(0x600), *range(0x1680, 0x1690), *range(0x1800, 0x1810), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0xFEFF, 0x4E2D, 0x1F642, 0x10FFFF]
    texts = [x + chr(c) + y for c in some for x in ("a", "", " ", "\n", "'", "3 ") for y in ("b", "", " b", "\n", "\nb", "  ", "'s", ".")]
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


@pytest.mark.parametrize(("path", "keeps"), [(tokens.WORD_BPE, False), (tokens.BYTE_BPE, True)])
def test_the_library_gets_little_at_a_time(path, keeps, monkeypatch):
    own, whole = tokens.tokens.__wrapped__(path, keeps), Tokenizer.from_file(path)
    texts = [prose(i, 30) + " \u3000日本" + "語" * i + "<|endoftext|>" * (i % 2) for i in range(40)] + ["", "a" * 500, "b" * 40]
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    sizes = []

    class Watched:
        def __init__(self, of):
            self.encode = of.encode_batch_fast

        def encode_batch_fast(self, texts, **options):
            sizes.append([len(t) for t in texts])
            return self.encode(texts, **options)

    own.tokenizer = Watched(own.tokenizer)
    if keeps:
        own.bulk = Watched(own.bulk)
    monkeypatch.setattr(tokens, "AT_ONCE", 50)
    assert own.encode(texts) == want
    assert all(sum(x[:-1]) <= 50 for x in sizes) and max(map(sum, sizes)) <= 50 + 500


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=20))
def test_grammar_round_trip(lists):
    ids = [np.array(x, "<u4").tobytes() for x in lists]
    block = repair.Block(repair.block_bytes(list(range(len(ids))), ids))
    for i in reversed(range(len(ids))):
        assert block.part(i).tobytes() == ids[i]
        for start, n in ((0, 1), (1, 3), (len(lists[i]) // 2, 7), (len(lists[i]), 2)):
            assert block.part(i, start, n).tolist() == lists[i][start : start + n]
    assert [x.tobytes() for x in block.documents()] == ids


def left_frequent(symbols, counts):
    """Pairs inside documents that occur FREQUENT times or more."""
    last = set((np.cumsum(counts) - 1).tolist())
    seen = Counter((a, b) for i, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)) if i not in last)
    return [p for p, n in seen.items() if n >= repair.FREQUENT]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=200), min_size=1, max_size=12))
def test_no_frequent_pair_is_left(lists):
    literals, rules, lengths, symbols, counts = repair.compress(np.concatenate(lists).astype("<u4"), np.array([len(x) for x in lists]))
    assert not left_frequent(symbols, counts) and len(counts) == len(lists)
    assert all(max(r) < len(literals) + i for i, r in enumerate(rules.tolist()))


def test_no_frequent_pair_is_left_in_texts():
    own = tokens.tokens(tokens.BYTE_BPE, True)
    phrases = [prose(i, 12) for i in range(300)]
    r = random.Random(3)
    ids, ends = own.batch([" ".join(r.choice(phrases) for _ in range(40)) for _ in range(400)] + ["a" * 5000, prose(5, 300) * 9])
    sizes = np.diff(ends, prepend=0)
    *_, symbols, counts = repair.compress(ids, sizes)
    assert not left_frequent(symbols, counts) and len(symbols) < len(ids) / 8
    monkey = ids.astype("<u4") + np.uint32(1 << 31)  # ids of any size
    assert repair.compress(monkey, sizes)[3].tolist() == symbols.tolist()


def test_grammar_compresses():
    ids = [np.tile(np.arange(50, dtype="<u4"), 40).tobytes()] * 5
    assert len(repair.block_bytes(list(range(5)), ids)) < sum(map(len, ids)) / 10


def test_words_of_many_batches_are_looked_up_once(monkeypatch):
    batch = lambda *texts: pa.RecordBatch.from_pydict({"text": list(texts)})
    batches = [batch(), batch("a b", "c"), batch(), batch("b c"), batch("a")]
    assert [x.column(0).to_pylist() for x in repair.together(iter(batches))] == [["a b", "c", "b c", "a"]]
    assert list(repair.together(iter([batch()]))) == []
    monkeypatch.setattr(repair, "TOGETHER", 1)  # no more than one batch, of any size
    assert [x.column(0).to_pylist() for x in repair.together(iter(batches))] == [["a b", "c"], ["b c"], ["a"]]


def test_rounds_count_exactly():
    r = np.random.default_rng(7)
    for _ in range(60):
        sizes = r.integers(1, 60, int(r.integers(1, 12)))
        ids = r.integers(0, int(r.integers(1, 6)), int(sizes.sum())).astype("<u4")
        literals, rules, _, symbols, counts = repair.compress(ids, sizes)
        of = [[int(x)] for x in literals]
        for a, b in rules.tolist():
            of.append(of[a] + of[b])
        ends = np.cumsum(counts).tolist()
        docs = [symbols[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
        assert [sum((of[x] for x in d), []) for d in docs] == [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        for d in docs:
            assert len(d) > 0
        seen = Counter(p for d in docs for p in zip(d, d[1:], strict=False))
        assert max(seen.values(), default=0) < repair.FREQUENT


def with_special(docs):
    """The rows, and texts with tokens of the vocabulary's own."""
    more = [(100 + i, t) for i, t in enumerate(SPECIAL)]
    return docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(more, "doc_id long, text string")), awkward() + more


def test_files(docs, no_docs):
    whole = Tokenizer.from_file(tokens.BYTE_BPE)
    df, texts = with_special(docs)
    rows = repair.read_files(repair.write_files(df, shards=3)).orderBy("start").collect()
    coded = Counter()
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        coded[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == coded
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert order == sorted(order)
    ahead = 0
    for r in rows:
        assert r["start"] == ahead
        ahead += r["n_tokens"]
    assert repair.read_files(repair.write_files(no_docs)).count() == 0


def test_one_document_touches_one_block(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 300)
    rows = [(i, prose(i, 40)) for i in range(60)] + [(7, "other text"), (None, "no id")]
    manifest = repair.write_files(spark.createDataFrame(rows, "doc_id long, text string"), shards=2).persist()
    whole = Tokenizer.from_file(tokens.BYTE_BPE)
    blocks = []
    kind = repair.Block
    monkeypatch.setattr(repair, "Block", lambda data: blocks.append(len(data)) or kind(data))
    for i in (0, 31, 59):
        ids = [*whole.encode(rows[i][1], add_special_tokens=False).ids, repair.END_ID]
        blocks.clear()
        assert [x.tolist() for x in repair.read_document(manifest, i)] == [ids] and len(blocks) == 1
        assert [x.tolist() for x in repair.read_document(manifest, i, 5, 9)] == [ids[5:14]]
    assert sorted(len(x) for x in repair.read_document(manifest, 7)) == sorted(len(whole.encode(t).ids) + 1 for i, t in rows if i == 7)
    assert repair.read_document(manifest, 1000) == []
    assert sum(r["docs"] for r in manifest.collect()) == len(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda cap: st.tuples(st.just(cap), st.lists(st.integers(1, cap), max_size=120))))
def test_plan(case):
    capacity, items = case
    rows = packing.plan(dict(Counter(items)), capacity)
    sequences, seen = defaultdict(list), defaultdict(set)
    for n, first, many, sequence, each, offset in rows:
        for k in range(many):
            assert first + k not in seen[n]
            seen[n].add(first + k)
            sequences[sequence + k // each].append((offset + k % each * n, n))
    assert {n: len(x) for n, x in seen.items()} == dict(Counter(items)) and all(x == set(range(len(x))) for x in seen.values())
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in own) <= 2
    # best fit decreasing never needs over 11/9 of the best, plus one
    assert len(sequences) <= 2 * -(-sum(items) // capacity)


def test_packed_rows(docs, no_docs):
    capacity = 64
    df, texts = with_special(docs)
    rows = packing.packed(df, capacity=capacity).collect()
    whole = Tokenizer.from_file(tokens.WORD_BPE)
    want = Counter()
    for i, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    own = defaultdict(list)
    for r in rows:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in own.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(own) <= 1.05 * sum(r["length"] for r in rows) / capacity + 1
    assert packing.packed(no_docs).count() == 0
