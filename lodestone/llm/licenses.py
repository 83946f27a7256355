"""Licence notices by a window classifier, confirmed against templates.

The classifier looks at all of a text in windows of eight and of 32 words that slide by half their size, so it does not matter how much else stands
in the paragraph.  A window is sparse word 1- and 2-grams, hashed; multinomial logistic regression, trained in
numpy on windows of templates in the midst of up to a hundred words of the corpus, and on windows of the corpus as the unknown class, gives each
licence family a probability.  The least probability that counts is calibrated on corpus windows kept
apart: below it a window is unknown.  A predicted family holds only if words near the window, in one paragraph (lines without a blank one between them, so notices may be
wrapped), cover enough of one of the family's templates.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Families and sentences that grant or name them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under CC BY-NC-SA 4.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY-SA 4.0.",
    ),
    "all-rights-reserved": (
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Sentences of licences that are no family here.
UNLISTED = {
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Library General Public License.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "gfdl": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc0": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under Creative Commons Zero 1.0 Universal."),
    "apache-1": ("Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.0."),
    "epl": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    "cddl": ("Licensed under the Common Development and Distribution License, version 1.0.",),
    "eupl": ("Licensed under the European Union Public Licence, version 1.2.",),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "zlib": ("Released under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications"),
    "boost": ("Distributed under the Boost Software License, Version 1.0.",),
    "artistic": ("Licensed under the Artistic License 2.0.",),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
}
FAMILIES = ("unknown", *TEMPLATES)
BUCKETS = 1 << 16
#: Corpus paragraphs that serve as the unknown class: at most so many, from so many documents at most.
#: Each of at most so many characters.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 1000, 20_000, 4000
VARIANTS = 60
EPOCHS, RATE, DECAY = 30, 0.5, 1e-5
#: Words of the classifier's windows, which slide by half; and how far from one a notice that it is part of may reach.
WINDOWS = (8, 32)
NEAR = 60
#: Words around a notice in training; and those around one that the confirmation sees.
AROUND = (0, 2, 5, 10, 20, 50)
BESIDE = 6
#: A template is matched if so much of its words is in the paragraph, in longest common word order.
COVER = 0.6
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def numbers(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words and of pairs of words that follow each other, by the words' hashes."""
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), ((pairs ^ pairs >> np.uint64(29)) % np.uint64(BUCKETS)).astype(np.int64)


def window_buckets(words: list[str]) -> np.ndarray:
    return np.concatenate(buckets(numbers(words)))


def sliding(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of all windows over n words."""
    starts = [np.arange(0, max(1, n - size // 2), size // 2) for size in WINDOWS]
    ends = [np.minimum(x + size, n) for x, size in zip(starts, WINDOWS, strict=True)]
    return np.concatenate(starts), np.concatenate(ends)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x families
    bias: np.ndarray
    least: float  # probability below which a window is unknown


def scored(found: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.array([weights[b].sum(0) / np.sqrt(max(1, len(b))) for b in found]) + bias


def fit(unknown: list[list[str]], seed: int = 3) -> Model:
    """``unknown``: lines of the corpus.  Those near a template are left out of the class; unlisted licences join it."""
    rng = np.random.default_rng(seed)
    prose = [w for w in unknown if w and not covers(w)]
    fill = [w for x in prose for w in x] or ["text"]

    def around() -> list[str]:
        """So many words of the corpus as they follow each other."""
        at, n = rng.integers(len(fill)), AROUND[rng.integers(len(AROUND))]
        return fill[at : at + rng.integers(0, n + 1)]

    def windows_of(base: list[str], telling: set[str]) -> Iterator[list[str]]:
        """The words, some of them missing, in the midst of others; the windows that have most of them or little else."""
        for i in range(VARIANTS):
            keep = base if i % 3 == 0 else [w for w in base if w in telling or rng.random() > 0.12]
            ahead = around()
            words = [*ahead, *keep, *around()]
            starts, ends = sliding(len(words))
            shared = np.minimum(ends, len(ahead) + len(keep)) - np.maximum(starts, len(ahead))
            good = np.flatnonzero(shared >= np.minimum(0.6 * (ends - starts), 0.8 * len(keep)))
            for at in rng.choice(good, min(2, len(good)), replace=False):
                yield words[starts[at] : ends[at]]

    def window_of(line: list[str]) -> list[str]:
        size = WINDOWS[rng.integers(len(WINDOWS))]
        at = rng.integers(max(1, len(line) - size // 2))
        return line[at : at + size]

    windows = [window_of(x) for x in prose]
    listed = [(n, x) for n, family in enumerate(FAMILIES[1:], 1) for base in TEMPLATE_WORDS[family] for x in windows_of(base, set())]
    near = [x for family in UNLISTED for base in TEMPLATE_WORDS[family] for x in windows_of(base, {w for w in base if w not in LISTED_WORDS})]
    kinds = [(2, n, x) for n, x in listed] + [(0, 0, x) for i, x in enumerate(windows) if i % 4] + [(1, 0, x) for i, x in enumerate(near) if i % 4]
    found = [window_buckets(x) for *_, x in kinds]
    marks, kind = np.array([m for _, m, _ in kinds]), np.array([k for k, *_ in kinds])
    share = (len(marks) / 3 / np.maximum(np.bincount(kind, minlength=3), 1))[kind]  # prose, unlisted and listed licences weigh the same
    used, place = np.unique(np.concatenate(found), return_inverse=True)
    size = np.array([len(b) for b in found])
    first = np.cumsum(size) - size
    w, bias = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    square = np.full_like(w, 1e-6)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(found)), max(1, len(found) // 2000)):
            begin = np.cumsum(size[part]) - size[part]
            p = place[np.repeat(first[part] - begin, size[part]) + np.arange(size[part].sum())]
            scale = 1 / np.sqrt(size[part])[:, None]
            g = softmax(np.add.reduceat(w[p], begin) * scale + bias)
            g[np.arange(len(part)), marks[part]] -= 1
            g *= (share[part] / len(part))[:, None]
            back = np.repeat(g * scale, size[part], 0)
            grad = np.stack([np.bincount(p, back[:, c], len(w)) for c in range(len(FAMILIES))], 1) + DECAY * w
            square += grad * grad
            w -= RATE * grad / np.sqrt(square)
            bias -= 0.1 * g.sum(0)
    weights = np.zeros((BUCKETS, len(FAMILIES)), np.float32)
    weights[used] = w
    # so high that of the prose kept apart at most one window in ten thousand passes, and of the unlisted licences one in ten, which the confirmation sees too; a half at least
    apart = [window_buckets(x) for x in windows[::4]]
    probability = softmax(scored(apart, weights, bias))[:, 1:].max(1) if apart else np.zeros(1)
    unlisted = softmax(scored([window_buckets(x) for x in near[::4]], weights, bias))[:, 1:].max(1)
    least = float(min(0.95, max(0.5, np.quantile(probability, 0.9999), np.quantile(unlisted, 0.9))))
    return Model(weights, bias, least)


def common_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


TEMPLATE_WORDS = {f: [words_of(t) for t in ts] for f, ts in (TEMPLATES | UNLISTED).items()}
LISTED_WORDS = {w for f in TEMPLATES for t in TEMPLATE_WORDS[f] for w in t}
#: word -> how well it tells licences apart: little if many have it.
WEIGHT = {w: 0.1 + math.log(len(TEMPLATE_WORDS) / sum(any(w in t for t in ts) for ts in TEMPLATE_WORDS.values())) for ts in TEMPLATE_WORDS.values() for t in ts for w in t}
#: Long paragraphs are compared in stretches of so many words, each half over the one before, so the cost follows the length.
STRETCH = 200


#: All templates side by side in one number: a bit for each word, and one between templates that stops the carry.
PLACES: list[tuple[str, int, int, int]] = []  # family, number in the family, first bit, words
BITS: dict[str, int] = {}  # word -> its places in all templates
FIELD = 0
_at = 0
for _family, _templates in TEMPLATE_WORDS.items():
    for _i, _template in enumerate(_templates):
        PLACES.append((_family, _i, _at, len(_template)))
        for _j, _word in enumerate(_template, _at):
            BITS[_word] = BITS.get(_word, 0) | 1 << _j
            FIELD |= 1 << _j
        _at += len(_template) + 1
#: No template is covered by fewer of its words.
FEWEST = min(n for *_, size in PLACES for n in range(size + 1) if n / size >= COVER)


def in_order(marks: list[int]) -> int:
    """The bits that ``common_order`` counts, for all templates at once.  ``marks``: BITS of words in their order."""
    v = FIELD
    for m in marks:
        u = v & m
        v = (v + u | v - u) & FIELD
    return FIELD & ~v


def stretches(words: list[str]) -> Iterator[tuple[int, list[str], int]]:
    """(start of a stretch, its words that a template has, the bits covered in order)."""
    for at in range(0, max(1, len(words) - STRETCH // 2), STRETCH // 2):
        known = [w for w in words[at : at + STRETCH] if w in BITS]
        if len(known) >= FEWEST:
            yield at, known, in_order([BITS[w] for w in known])


def reached(words: list[str]) -> list[tuple[int, str, int, float]]:
    """(start of a stretch, family, number of the template, part covered in order) where that is COVER at least."""
    found = []
    for at, _, bits in stretches(words):
        for family, i, first, size in PLACES:
            part = (bits >> first & (1 << size) - 1).bit_count() / size
            if part >= COVER and family in TEMPLATES:
                found.append((at, family, i, part))
    return found


def covers(words: list[str]) -> dict[tuple[str, int], float]:
    """The templates that the paragraph covers by COVER at least: (family, number) and the largest part covered in order."""
    found = {}
    for _, family, i, part in reached(words):
        found[family, i] = max(part, found.get((family, i), 0.0))
    return found


def likeness(words: list[str], families) -> tuple[float, float]:
    """(largest likeness to a template, largest part of one's weight covered) over the templates of some families.

    Words count by how well they tell licences apart; likeness also counts what the paragraph has beyond the template.
    """
    like = part = 0.0
    for _, known, bits in stretches(words):
        whole = sum(WEIGHT[w] for w in known)
        for family, i, first, size in PLACES:
            if family in families:
                template = TEMPLATE_WORDS[family][i]
                own = bits >> first & (1 << size) - 1
                covered = sum(WEIGHT[w] for j, w in enumerate(template) if own >> j & 1)
                all_ = sum(WEIGHT[w] for w in template)
                like, part = max(like, 2 * covered / (whole + all_)), max(part, covered / all_)
    return like, part


def windows(words: list[str], where: list[tuple[int, str, int, float]]) -> Iterator[tuple[int, int, str, int, int]]:
    """(first word, last word, family, words covered, words of the template) of the smallest windows that cover so much.  ``where``: from ``reached``."""
    for at, family, n, _ in where:
        template = TEMPLATE_WORDS[family][n]
        bits = {w: sum(1 << j for j, x in enumerate(template) if x == w) for w in template}
        size, full = len(template), (1 << len(template)) - 1
        marks = [(j, bits[w]) for j, w in enumerate(words[at : at + STRETCH], at) if w in bits]
        ends = [len(words)] * (size + 1)  # of the windows that start later, by words covered
        for s in range(len(marks) - 1, -1, -1):
            v, level = full, 0
            for j, m in marks[s:]:
                u = v & m
                v = (v + u | v - u) & full
                if size - v.bit_count() > level:
                    level += 1
                    if level / size >= COVER and j < ends[level]:
                        ends[level] = j
                        yield marks[s][0], j, family, level, size


def blocks(text: str | None) -> Iterator[list[tuple[int, int, list[str]]]]:
    """(start character, end, words) of the lines between blank lines."""
    block, at = [], 0
    for line in [*(text or "").split("\n"), ""]:
        if line and not line.isspace():
            block.append((at, at + len(line), words_of(line)))
        elif block:
            yield block
            block = []
        at += len(line) + 1


def joined(lines: list[list[str]]) -> tuple[list[str], list[int]]:
    """The words of all lines, and each word's line."""
    return [w for line in lines for w in line], [i for i, line in enumerate(lines) for _ in line]


def other_lines(text: str | None) -> list[list[str]]:
    """The lines but those that are part of a wrapped notice: of a window that covers a template and is covered by it."""
    kept = []
    for block in blocks(text):
        lines = [words for *_, words in block]
        words, line_of = joined(lines)
        notice = set()
        for a, b, _, n, _ in windows(words, reached(words)):
            if n / (b - a + 1) >= COVER:
                notice.update(range(line_of[a], line_of[b] + 1))
        kept += [line for i, line in enumerate(lines) if line and i not in notice]
    return kept


def match(words: list[str], family: str) -> tuple[float, int]:
    """The largest part of a template that the paragraph covers in order, and which template; (0, -1) below COVER."""
    part, i = max(((part, -i) for (f, i), part in covers(words).items() if f == family), default=(0.0, 1))
    return part, -i


#: Words that are classified at once.
AT_ONCE = 1 << 16


class Hashes(dict):
    """word -> its hash; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Scanner:
    def __init__(self, model: Model):
        self.model = model
        self.hashes = Hashes()

    def classified(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, end, family, probability) of the windows that aren't unknown, in order."""
        found = []
        for at in range(0, max(1, len(words) - WINDOWS[-1]), AT_ONCE):
            part = words[at : at + AT_ONCE + WINDOWS[-1]]
            if not part:
                break
            single, pair = buckets(np.fromiter(map(self.hashes.__getitem__, part), np.uint64, len(part)))
            singles, pairs = (np.cumsum(self.model.weights[np.append(x, 0)], 0, np.float64) for x in (single, pair))
            starts, ends = sliding(len(part))
            x = singles[ends - 1] - singles[starts] + self.model.weights[single[starts]]
            inner = ends - starts > 1
            x[inner] += pairs[ends[inner] - 2] - pairs[starts[inner]] + self.model.weights[pair[starts[inner]]]
            p = softmax(x / np.sqrt(2 * (ends - starts) - 1)[:, None] + self.model.bias)
            best = p[:, 1:].argmax(1) + 1
            sure = p[np.arange(len(p)), best]
            for i in np.flatnonzero((sure >= self.model.least) & (sure > p[:, 0])).tolist():
                found.append((at + int(starts[i]), at + int(ends[i]), FAMILIES[best[i]], float(sure[i])))
        return sorted(found)

    def paragraph(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, part of its template) of the best notice, or None."""
        return next((hit[:3] for hit in self.notices(words, self.classified(words), 0, len(words))), None)

    @staticmethod
    def over(classified: list[tuple[int, int, str, float]], start: int, end: int) -> list[tuple[int, int, str, float]]:
        """The windows that have some of the words from start to end."""
        at = bisect.bisect_left(classified, (start - WINDOWS[-1],)), bisect.bisect_left(classified, (end,))
        return [c for c in classified[slice(*at)] if c[1] > start]

    def notices(self, words: list[str], classified: list[tuple[int, int, str, float]], start: int, end: int) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, part of its template, first word, last word) of notices in a paragraph's words, the best covered first, then those of the longest template, then the shortest.

        Templates of a window's family are looked for up to NEAR words from it; words must cover enough of one, and be covered by it.  A word is in one notice only, and notices of a family have some words between them.
        """
        tries = set()
        for family in {c[2] for c in classified}:
            own = sorted((max(start, a - NEAR), min(end, b + NEAR)) for a, b, f, _ in classified if f == family)
            joined_up: list[list[int]] = []
            for a, b in own:
                if joined_up and a <= joined_up[-1][1]:
                    joined_up[-1][1] = max(b, joined_up[-1][1])
                else:
                    joined_up.append([a, b])
            for a, b in joined_up:
                part = words[a:b]
                where = [r for r in reached(part) if r[1] == family]
                tries |= {(-n / size, -size, j - i, a + i, a + j, f) for i, j, f, n, size in windows(part, where) if n / (j - i + 1) >= COVER}
        taken: set = set()
        hits = []
        for cover, _, _, a, b, family in sorted(tries):
            own = {*range(a, b + 1), *((family, x) for x in range(a - BESIDE, b + BESIDE + 1))}
            if taken.isdisjoint(own) and self.confirmed(words[max(start, a - BESIDE) : min(end, b + BESIDE + 1)], family):
                taken |= own
                sure = max((p for *_, f, p in self.over(classified, a, b + 1) if f == family), default=self.model.least)
                hits.append((family, sure, -cover, a, b))
        return hits

    def confirmed(self, words: list[str], family: str) -> bool:
        """Whether the words have enough of what tells the family apart, and no unlisted licence is more like them."""
        like, part = likeness(words, {family})
        return part >= COVER and like >= likeness(words, UNLISTED)[0]

    def text(self, text: str | None) -> tuple[int, list[tuple]]:
        """Number of lines that aren't blank; (family, probability, cover, start character, end) of each notice."""
        found = list(blocks(text))
        words, lines = [], []  # of a line: start character, end, first word
        bounds = []
        for block in found:
            begin = len(words)
            for a, b, own in block:
                lines.append((a, b, len(words)))
                words += own
            bounds.append((begin, len(words)))
        hits = []
        if classified := self.classified(words):
            firsts = [n for *_, n in lines]
            spans: dict[int, list[tuple[int, int]]] = {}

            def place(word: int) -> tuple[int, int]:
                """Where a word starts and ends; the line's own start, or end, where no other word is before, or after it."""
                i = bisect.bisect_right(firsts, word) - 1
                a, b, first = lines[i]
                if i not in spans:
                    at = [a + j for j, c in enumerate(text[a:b]) for _ in c.lower()]
                    spans[i] = [(at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer(text[a:b].lower())]
                n = word - first
                return a if n == 0 else spans[i][n][0], b if n == len(spans[i]) - 1 else spans[i][n][1]

            for begin, end in bounds:
                if own := self.over(classified, begin, end):
                    hits += [(family, sure, cover, place(a)[0], place(b)[1]) for family, sure, cover, a, b in self.notices(words, own, begin, end)]
        return len(lines), sorted(hits, key=lambda h: h[3:])


def train(docs: DataFrame) -> Model:
    """Takes the unknown class from at most SAMPLE_DOCS documents, those whose ids have the smallest hashes, without lines of wrapped notices."""
    small_batches(docs.sparkSession)
    chosen = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [" ".join(x[i : i + STRETCH])[:SAMPLE_CHARS] for t in b.column(0).to_pylist() for x in other_lines(t) for i in range(0, len(x), STRETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])

    lines = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(run, "line string")
    rows = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect()
    return fit([r[0].split(" ") for r in rows])


NOTICES = "array<struct<family: string, probability: double, cover: double, start: int, end: int>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, notices (family, probability, part of the template, characters from start to end) of each row.

    n_paragraphs counts lines that aren't blank; a notice goes from its first word to its last, and to the start or end of a line that has no other word there.  Null and empty texts have no paragraphs.  Repeated rows and null ids stay; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(shipped.value)
        names = ("family", "probability", "cover", "start", "end")
        kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [own.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[dict(zip(names, h, strict=True)) for h in hits] for _, hits in found], kind)], ["doc_id", "n_paragraphs", "notices"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_paragraphs long, notices {NOTICES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("notices")
    return scan(docs, train(docs)).select(
        "doc_id", "n_paragraphs", F.size(n).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(n["family"])), ",").alias("families"),
        F.round(F.coalesce(F.array_max(n["cover"]), F.lit(0.0)), 6).alias("best_cover"),
        F.coalesce(F.array_min(n["start"]), F.lit(-1)).alias("first_start"),
    )
