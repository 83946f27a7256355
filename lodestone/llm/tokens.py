"""Ids of whole texts by vocabularies of the tokenizers library, through a memo of their words."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .memo import Memo

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


#: A word of plain Latin letters, maybe with ASCII marks after it: these are one or two pre-tokens of the vocabulary of words,
#: which its merge model takes as they stand.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)")

#: Kinds of bytes: of letters, digits, an apostrophe, other ASCII marks, a space, a line end, the first of a character that is not
#: white space, any other.
LETTER, DIGIT, QUOTE, MARK, SPACE, LINE, OTHER, UNSURE = range(8)
#: What two kinds side by side say: a pre-token begins between them; one begins before both; they may be parts of two pre-tokens.
BETWEEN, BEFORE, LOOSE = 1, 2, 4
#: About so many letters go to the library at a time: what it holds for each is a hundred times as large.
AT_ONCE = 1 << 17


def byte_letters() -> dict[int, str]:
    """Latin-1 code of each byte -> the letter that stands for it in byte-level vocabularies.

    Printable bytes stand for themselves, others for the letters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def kind_table() -> np.ndarray:
    kind = np.full(256, UNSURE, np.uint8)
    kind[33:127], kind[39], kind[32], kind[10] = MARK, QUOTE, SPACE, LINE
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[0xC3:0xE1] = kind[0xE4:0xF5] = OTHER  # white space beyond ASCII begins with C2, E1, E2 or E3
    return kind


def pair_table() -> np.ndarray:
    """What 8 * one kind + the next says, by the usual pattern of byte-level vocabularies.

    Nothing but a single white-space character before something else is sure to be no part of what is before it.
    An apostrophe may take a letter or two after it.
    """
    pair = np.zeros((8, 8), np.uint8)
    visible = [LETTER, DIGIT, QUOTE, MARK]
    for a in visible:
        pair[a, [SPACE, LINE]] = BETWEEN
        for b in visible:
            if a != b and {a, b} != {QUOTE, MARK} and (a, b) != (QUOTE, LETTER):
                pair[a, b] = BETWEEN
    pair[SPACE, [*visible, OTHER]] = BEFORE
    pair[LINE, [*visible, OTHER]] = BEFORE | BETWEEN
    pair[[OTHER, UNSURE]] |= LOOSE
    pair[:, [OTHER, UNSURE]] |= LOOSE
    pair[QUOTE, LETTER] |= LOOSE
    return pair.ravel()


KIND, PAIR = kind_table(), pair_table()


def said(data: np.ndarray) -> np.ndarray:
    """What each byte of UTF-8 and the next say."""
    kind = KIND.take(data)
    first = np.flatnonzero((data >= 0xC3) & (data <= 0xD1))  # Latin and Cyrillic letters of two bytes
    first = first[first < len(data) - 1]
    a, b = data[first], data[first + 1]
    good = (b & 0xC0 == 0x80) & ((a <= 0xC8) | (a == 0xC9) & (b < 0x90) | (a >= 0xD0)) & ((a != 0xC3) | (b != 0x97) & (b != 0xB7))
    first = first[good]
    kind[first] = kind[first + 1] = LETTER
    return PAIR.take(kind[:-1] << 3 | kind[1:])


def begins(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places at which texts, and in them pre-tokens, are sure to begin.  What lies between two of them is encoded alike alone."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        pairs = said(data)
        inner = ends[(ends > 0) & (ends < len(data))]
        pairs[inner - 1] = 0  # of two texts
        cut[1:-1] = pairs & BETWEEN
        cut[:-2] |= (pairs & BEFORE).astype(bool)
        cut[0] = cut[inner] = True
    return np.flatnonzero(cut)


class WordMemo(dict):
    """word -> ids, encoded when first met.

    Holds about ``limit`` bytes in two halves: when the newer one is full the older one goes, and words of it that are met again move over.
    """

    def __init__(self, encode, limit: int = 256 << 20):
        super().__init__()
        self.encode, self.limit, self.held = encode, limit, 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if self.held > self.limit >> 1:
            self.older = dict(self)
            self.clear()
            self.held = 0
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        self.held += 200 + 2 * len(word) + len(ids)
        return ids


def spread(known: list[bytes], place: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words in a row, and where each text's end: ``known`` by word, ``place`` says which word, ``ends`` where each text's words end."""
    size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
    start = np.cumsum(size) - size
    n = size.take(place)
    upto = np.concatenate([[0], np.cumsum(n)])
    total = int(upto[-1])
    small = np.int32 if total < 1 << 31 else np.int64
    source = np.repeat((start.take(place) - upto[:-1]).astype(small), n)
    source += np.arange(total, dtype=small)
    return np.frombuffer(b"".join(known), "<u4").take(source), upto[ends]


class Tokens:
    """By a vocabulary of words, to which white space doesn't belong."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.marks = WordMemo(lambda m: self.direct([m])[0], 8 << 20)
        self.memo = WordMemo(self.word)
        self.number = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def word(self, text: str) -> bytes:
        """Ids of a text without white space; those of a plain word by the merge model alone."""
        if not text:
            return b""
        m = PLAIN.fullmatch(text)
        if not m:
            return self.direct([text])[0]
        word, marks = m.groups()
        word, number = word.lower(), self.number
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([number[x.id] for x in self.model.tokenize(shown)])
        return ids + self.marks[marks] if marks else ids

    def direct(self, texts: list[str]) -> list[bytes]:
        out = []
        for _, own in groupby(zip(texts, accumulate(map(len, texts)), strict=True), lambda x: x[1] // AT_ONCE):
            found = self.tokenizer.encode_batch_fast([t for t, _ in own], add_special_tokens=False)
            out += [np.array(x.ids, "<u4").tobytes() for x in found]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as the library gives them for the whole text."""
        ids, ends = self.batch(texts)
        whole, ends = ids.tobytes(), (4 * ends).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end.

        Arrow splits the texts and numbers their words, so only a batch's distinct words are looked up one by one.
        Texts with a token of the vocabulary's own (``<|endoftext|>``), which the library finds across words, go to it whole.
        """
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        entries, texts = self.direct([texts[i] for i in whole]), list(texts)
        for i in whole:
            texts[i] = ""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        known = list(map(self.memo.__getitem__, coded.dictionary.to_pylist()))
        if whole:  # each is one empty word so far
            place[np.concatenate([[0], ends[:-1]])[whole]] = len(known) + np.arange(len(whole))
            known += entries
        return spread(known, place, ends)


class ByteTokens(Tokens):
    """By a byte-level vocabulary with the usual pattern, where a space belongs to the word after it.

    Texts are cut where a pre-token surely begins, so that a word is one piece with or without marks around it.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.memo = Memo(self.pieces, 256 << 20)
        self.bulk = Tokenizer(self.model)
        self.bulk.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.complete = set(self.letters.values()) <= self.tokenizer.get_vocab(False).keys()  # else bytes may be lost
        self.spells = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(len(self.number))])
        self.shown = np.array([ord(self.letters[b]) for b in range(256)], "<u2")
        self.shown[0xFF] = 10  # no byte of UTF-8: it parts pieces

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: the library's merge model takes many single pre-tokens at a time, the library itself all other pieces."""
        data = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size + 1)
        pairs = said(data)
        pairs[ends[:-1] - 1] = pairs[ends - 2] = 0  # beside what parts two pieces
        loose = np.append(pairs & LOOSE, 0).astype(bool)
        single = ~np.logical_or.reduceat(loose, ends - size - 1) & self.complete
        shown = self.shown.take(data[np.repeat(single, size + 1)])
        upto = np.cumsum(size[single] + 1)
        found = []
        first = np.flatnonzero(np.diff(upto // AT_ONCE, prepend=-1)).tolist()
        for i, j in zip(first, [*first[1:], len(upto)], strict=True):
            own, begin = upto[i:j], int(upto[i - 1]) if i else 0
            ids = np.array(self.bulk.encode_batch_fast([shown[begin : own[-1]].tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
            letters = own - begin - np.arange(1, len(own) + 1)  # of these pieces up to the end of each
            last = 4 * (np.searchsorted(np.cumsum(self.spells[ids]), letters) + 1)
            whole, last = ids.tobytes(), last.tolist()
            found += [whole[a:b] for a, b in zip([0, *last], last, strict=False)]
        if not single.all():
            rest = self.direct([pieces[i].decode() for i in np.flatnonzero(~single).tolist()])
            singles, others = iter(found), iter(rest)
            found = [next(singles if x else others) for x in single.tolist()]
        return found

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.array(texts, pa.large_string())
        own = np.zeros(len(rows), bool)
        for x in self.added:
            own |= pc.match_substring(rows, x).to_numpy(zero_copy_only=False)
        entries = self.direct([texts[i] for i in np.flatnonzero(own).tolist()])
        if entries:
            rows = pc.if_else(pa.array(own), pa.scalar("", pa.large_string()), rows)
        ends = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1)[1:] if len(rows) else np.zeros(0, np.int64)
        n = int(ends[-1]) if len(ends) else 0
        data = rows.buffers()[2] if n else pa.py_buffer(b"")
        begin = begins(np.frombuffer(data, np.uint8, n), ends)
        bounds = pa.py_buffer(np.append(begin, n))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, bounds, data]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        place = coded.indices.to_numpy()
        self.memo.fill(words, b"")
        known = list(map(self.memo.__getitem__, words))
        ends = np.searchsorted(begin, ends)
        if entries:  # each is one piece more, after those of the texts before
            place = np.insert(place, ends[own], len(known) + np.arange(len(entries)))
            ends = ends + np.cumsum(own)
            known += entries
        return spread(known, place, ends)


@lru_cache(4)
def tokens(path: str, keeps_space: bool) -> Tokens:
    """One for each Python worker.  ``keeps_space``: whether a space belongs to the word after it, as in byte-level vocabularies."""
    return ByteTokens(path) if keeps_space else Tokens(path)
