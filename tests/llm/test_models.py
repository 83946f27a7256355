"""The trained classifiers and the pipeline."""

import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import licenses, toxicity

from .conftest import prose

BAD = ("clown", "scum", "pathetic", "idiot")


def labelled(n):
    r = random.Random(1)
    rows = []
    for i in range(n):
        words, toxic = ("the " + prose(i, r.randint(5, 120))).split(), i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randint(0, len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled(700)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0.1, 2) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(spark, tables, docs, no_docs):
    model = toxicity.train(*tables)
    rows = toxicity.scored(tables[0].drop("score", "predicted"), model).collect()
    truth = {i: y for i, _, y in labelled(700)}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    some = toxicity.scored(docs.drop("score", "predicted"), model).collect()
    assert len(some) == docs.count() and len({r["score"] for r in some if not (r["text"] or "").strip()}) == 1
    assert toxicity.scored(no_docs.drop("score", "predicted"), model).count() == 0
    none = toxicity.train(no_docs, tables[1])
    assert toxicity.scored(docs.drop("score", "predicted"), none).count() == docs.count()
    # clashing names: the operator's own columns come last, the others stay
    assert toxicity.scored(tables[0], model).columns == [*tables[0].columns, "score", "predicted"]


def test_pooling_of_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(w, 50, 4)).astype(np.float32) for w in (1, 2, 3)]
    ids = rng.integers(0, 50, 500)
    whole = toxicity.pooled(tables, ids)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    parts = toxicity.pooled(tables, ids)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    for t in tables:
        t[:, 0] = 0
    sparse = np.where(rng.random(500) < 0.1, ids, 0)
    assert np.array_equal(toxicity.pooled(tables, sparse)[0], toxicity.pooled(tables, toxicity.useful(sparse))[0])


def test_sample_is_bounded(tables, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(len(texts)) or toxicity.Model(np.zeros(toxicity.BUCKETS, np.int32), np.zeros((1, 8), np.float32), [np.zeros((w, 8, 8), np.float32) for w in toxicity.WIDTHS], np.zeros(24), np.zeros(24), 0.0))
    toxicity.train(*tables, sample=50)
    assert seen == [40]


def test_one_long_text_leaves_the_others(spark, tables, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 20_000)
    docs, labels = tables
    for long in (0, 7, 350):
        more = docs.where(f"doc_id <> {long}").unionByName(spark.createDataFrame([(long, "word " * 30_000, "en", "s", 1, 0.1, 2)] * 2, docs.schema))
        model = toxicity.train(more, labels)
        assert len(model.embedding) > 1
        scorer = toxicity.Scorer(model)
        assert scorer.score(f"the {prose(1, 20)} scum {prose(2, 9)} idiot") > 0.5 > scorer.score("the " + prose(1, 29))
    taken = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: taken.append(sum(map(len, texts))) or fit(texts, marks))
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 5000)
    toxicity.train(docs, labels)
    assert 3000 < taken[0] <= 5000


def test_licenses(spark, docs, no_docs):
    model = licenses.fit([prose(i, 12).split() for i in range(400)])
    scanner = licenses.Scanner(model)
    for family, templates in licenses.TEMPLATES.items():
        for x in templates:
            n, hits = scanner.text(f"{prose(900, 30)}\n{x}\n\n{prose(901, 9)}")
            assert n == 3 and [h[0] for h in hits] == [family], x
            assert hits[0][4] - hits[0][3] == len(x)
    for clean in (prose(50, 40), "the licence of the driver was free of charge", "version 2 of the work", ""):
        assert not scanner.text(clean)[1]
    rows = licenses.scan(docs, model).collect()
    assert len(rows) == docs.count() and sum(len(r["notices"]) for r in rows) == 0
    assert licenses.scan(no_docs, model).count() == 0
    held = [licenses.words_of(prose(i, 15)) for i in range(5000, 5400)]
    assert not any(scanner.paragraph(w) for w in held)


def test_license_order():
    assert licenses.common_order("a b c d".split(), "a x c d".split()) == 3
    long = "word " * 1000 + licenses.TEMPLATES["mit"][0]
    assert licenses.match(licenses.words_of(long), "mit")[0] == 1.0


def test_license_words_common_in_the_corpus():
    # talk of licences that covers no template: each word of the notices is frequent in the unknown class
    words = sorted({w for t in ("mit", "all-rights-reserved", "bsd") for x in licenses.TEMPLATE_WORDS[t] for w in x})
    talk = [f"{prose(i, 6)} {words[i % len(words)]} {prose(i + 9000, 5)}".split() for i in range(600)]
    scanner = licenses.Scanner(licenses.fit(talk))
    for x, family in (("Released under the MIT License.", "mit"), ("Copyright. All rights reserved.", "all-rights-reserved"), ("Licensed under the BSD 3-Clause License.", "bsd")):
        assert [h[0] for h in scanner.text(f"{prose(1, 20)}\n{x}")[1]] == [family]
    assert not any(scanner.text(" ".join(t))[1] for t in talk)


@pytest.mark.parametrize(("columns", "mark"), [(70, ""), (70, "# "), (35, " * ")])
def test_wrapped_licenses(spark, columns, mark):
    texts = {}
    for family, templates in licenses.TEMPLATES.items():
        for x in templates:
            texts[len(texts)] = family, textwrap.fill(x, columns, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False)
    # a sample in which every notice stands wrapped, besides prose
    df = spark.createDataFrame([(i, f"{prose(i, 12)}\n{x}\n\n{prose(i + 99, 9)}") for i, (_, x) in texts.items()] + [(i, prose(i, 12)) for i in range(1000, 1400)], "doc_id long, text string")
    scanner = licenses.Scanner(licenses.train(df))
    for i, (family, x) in texts.items():
        text = f"{prose(900, 12)}\n{x}\n{prose(902, 8)}\n\n{prose(901, 9)}\n{prose(903, 9)}"
        n, hits = scanner.text(text)
        assert n == len(x.split("\n")) + 4 and {h[0] for h in hits} == {family}, (x, hits)
        assert max(h[2] for h in hits) == 1.0 and any(text[h[3] : h[4]] == x for h in hits), (x, hits)
    for i in range(200):
        assert not scanner.text("\n".join(prose(7000 + 9 * i + j, 9) for j in range(9)))[1]


#: (family or None, notice): as they stand in real files, with other years, names and versions.
NOTICES = [
    ("mit", "Released under the MIT License."), ("mit", "This project is licensed under the terms of the MIT license, see LICENSE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 2."), ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), ("bsd", "Licensed under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."), ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."), ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("all-rights-reserved", "Copyright 2019 Example. All rights reserved."),
    (None, "Licensed under the GNU Lesser General Public License 2.1."), (None, "This work is licensed under the GNU Lesser General Public License, version 3."), (None, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    (None, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."), (None, "You should have received a copy of the GNU Affero General Public License along with this program."),
    (None, "Licensed under CC BY-ND 4.0."), (None, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."), (None, "Licensed under CC0 1.0."), (None, "Licensed under the Apache License, Version 1.1."),
    (None, "Licensed under the Eclipse Public License, version 2.0."), (None, "Released under the ISC License."), (None, "Released under the zlib License."), (None, "Distributed under the Boost Software License, Version 1.0."), (None, "Licensed under the European Union Public Licence, version 1.2."),
    (None, "No part of the programme may be repeated without written notice to the station."), (None, "The licence of the driver was free of charge and all rights of way were reserved."),
]


def test_planted_notices(spark):
    rows, truth = [], {}
    for n in range(660):
        family, notice = NOTICES[n % len(NOTICES)]
        width = (0, 70, 40)[n // len(NOTICES) % 3]
        notice = textwrap.fill(notice, width, break_long_words=False, break_on_hyphens=False) if width else notice
        rows.append((n, f"{prose(n, 25)}\n\n{notice}\n\n{prose(n + 5000, 20)}" if n % 2 else f"{prose(n, 12)}\n{notice}\n{prose(n + 5000, 9)}"))
        truth[n] = family
    rows += [(n, f"{prose(n, 30)}\n{prose(n + 1, 12)}") for n in range(1000, 1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    right = found = wanted = 0
    for r in licenses.scan(df, licenses.train(df)).collect():
        families = {x["family"] for x in r["notices"]}
        family = truth.get(r["doc_id"])
        found += len(families)
        wanted += family is not None
        right += family in families
        for x in r["notices"]:
            assert 0 <= x["start"] < x["end"] <= len(dict(rows)[r["doc_id"]])
    assert right >= 0.95 * wanted and right >= 0.95 * found, (right, wanted, found)


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.fit([prose(i, 5 + i % 90).split() for i in range(1500)]))


@pytest.mark.parametrize("n", [0, 10, 20, 40, 100, 1000])
def test_notices_inside_paragraphs(scanner, n):
    """At the start, in the middle and at the end of a line of n other words."""
    right = found = wanted = 0
    for k in range(6):
        for i, (family, notice) in enumerate(NOTICES):
            words = prose(97 * k + i + 10 * n, n).split()
            cut = (0, n // 2, n)[k % 3]
            before = " ".join([*words[:cut], ""])
            text = f"{prose(k, 9)}\n{before}{notice} {' '.join(words[cut:])}".rstrip()
            hits = scanner.text(text)[1]
            families = {h[0] for h in hits}
            found += len(families)
            wanted += family is not None
            right += family in families
            for h in hits:
                assert 0 <= h[3] < h[4] <= len(text)
                if n and h[0] == family:  # within the line the notice alone is named
                    assert h[4] - h[3] <= len(notice) + 2 * len(prose(k, 9)) and text[h[3] : h[4]] in text
    assert right >= 0.95 * wanted and right >= 0.95 * found, (n, right, wanted, found)


def test_two_wrapped_licenses():
    scanner = licenses.Scanner(licenses.fit([prose(i, 12).split() for i in range(400)]))
    mit, gpl = (textwrap.fill(licenses.TEMPLATES[f][2 if f == "mit" else 1], 70) for f in ("mit", "gpl"))
    hits = scanner.text(f"{mit}\n{gpl}\n{mit}")[1]
    assert [h[0] for h in hits] == ["mit", "gpl", "mit"] and [h[2] for h in hits] == [1.0] * 3
    # a blank line parts paragraphs
    assert not scanner.text(mit.replace("\n", "\n\n"))[1]


def test_license_covers():
    r = random.Random(2)
    words = sorted(licenses.BITS) + ["other"] * 9
    for n in range(300):
        family, i, _, size = r.choice(licenses.PLACES)
        base = [w for w in licenses.TEMPLATE_WORDS[family][i] if r.random() > 0.3]
        for _ in range(r.randint(0, 20)):
            base.insert(r.randint(0, len(base)), r.choice(words))
        want = {(f, j): licenses.common_order(t, base) / len(t) for f in licenses.TEMPLATES for j, t in enumerate(licenses.TEMPLATE_WORDS[f])}
        assert licenses.covers(base) == {k: v for k, v in want.items() if v >= licenses.COVER}
    # 12 different words, but 18 of the 29 places
    mit = licenses.TEMPLATE_WORDS["mit"][2]
    often = [w for w in mit if mit.count(w) > 1]
    rest = [w for w in mit if mit.count(w) == 1][: 18 - len(often)]
    assert licenses.match([w for w in mit if w in often or w in rest], "mit") == (18 / 29, 2)


def test_pipeline(spark, tables, tmp_path):
    docs, labels = tables
    kind = docs.drop("score", "predicted")
    clean = prose(5000, 60)
    more = spark.createDataFrame([(1000, clean, "en", "s", 1), (1001, clean, "en", "s", 1), (1002, f"{prose(5001, 30)} {clean}", "en", "s", 1), (1003, "", "en", "s", 0), (1004, None, "en", "s", None), (None, prose(5002, 30), "en", "s", 2)], kind.schema)
    kind.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    (_, toxic), (_, near), (_, passages), (_, pack) = corpus_pipeline.STAGES
    kept = toxic(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns
    ids = Counter(r[0] for r in kept.select("doc_id").collect())
    truth = {i: y for i, _, y in labelled(700)}
    assert sum(truth[i] for i in ids if i in truth) <= 20 and sum(not y for i, y in truth.items() if i not in ids) <= 15
    one = near(spark, rows, str(tmp_path))
    left = {r[0] for r in one.select("doc_id").collect()}
    assert one.columns == rows.columns and 1000 in left and 1001 not in left and None in left and 1003 in left and 1004 not in left  # null texts count as empty ones
    # rows that share an id: different texts are judged on their own, of equal ones one stays
    other = prose(5003, 40)
    shared = spark.createDataFrame([(1, clean, "en", "s", 1), (2, clean, "en", "s", 1), (2, other, "en", "s", 1), (2, other, "en", "s", 1), (None, prose(5004, 30), "en", "s", 1), (None, prose(5004, 30), "en", "s", 1), (1, clean, "en", "s", 1)], kind.schema)
    assert Counter((r[0], r[1]) for r in near(spark, shared, str(tmp_path)).collect()) == Counter([(1, clean), (2, other), (None, prose(5004, 30))])
    less = passages(spark, one, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in less.collect()}
    assert less.columns == rows.columns and texts[1000] == clean and texts[1002] == prose(5001, 30) and texts[1003] == ""
    assert {r["doc_id"] for r in pack(spark, less, str(tmp_path)).collect()} == set(texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = str(tmp_path / "none")
    rows.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
