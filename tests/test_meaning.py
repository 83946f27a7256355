"""Embeddings learned from pairs of words: planted synonyms, repetition, edges."""

import json
import random

import numpy as np
import pytest

from lodestone import cli
from lodestone.functions import meaning
from lodestone.functions.embedding import HashEmbedder, embedded

TOPICS = 12


def corpus(n=1500):
    """Each topic has words of its own and pairs of synonyms, which never stand in one text together."""
    r = random.Random(4)
    rows = []
    for i in range(n):
        t, side = i % TOPICS, r.randrange(2)
        words = [f"topic{t}word{r.randrange(8)}" for _ in range(12)] + [f"{'left' if side else 'right'}{t}x{r.randrange(3)}" for _ in range(6)] + [f"common{r.randrange(5)}" for _ in range(10)]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*corpus(), (-1, None), (-2, ""), (-3, "...")], "id long, text string").repartition(5)


@pytest.fixture(scope="module")
def model(texts):
    return meaning.train(texts, dim=24, words=500)


def ndcg(encode):
    """Queries of left words, texts of right words alone: those of the query's topic are right."""
    docs = [(t, f"right{t}x{a} right{t}x{b}") for t in range(TOPICS) for a in range(3) for b in range(3)]
    x = encode([d for _, d in docs])
    total = 0.0
    for t in range(TOPICS):
        q = encode([f"left{t}x0 left{t}x1"])[0]
        order = np.argsort(-(x @ q), kind="stable")[:9]
        total += sum((docs[i][0] == t) / np.log2(k + 2) for k, i in enumerate(order)) / sum(1 / np.log2(k + 2) for k in range(9))
    return total / TOPICS


def test_synonyms(model):
    learned, hashed = ndcg(meaning.MeaningEmbedder(model).encode), ndcg(HashEmbedder(24).encode)
    assert learned > 0.95 and learned > hashed + 0.3, (learned, hashed)


def test_same_vectors_on_repeat(spark, texts, model, tmp_path):
    again = meaning.train(texts.repartition(3), dim=24, words=500)
    assert again.words == model.words and np.abs(again.vectors - model.vectors).max() < 1e-4
    meaning.save(spark, model, str(tmp_path / "m"))
    back = meaning.load(spark, str(tmp_path / "m"))
    assert back.words == model.words and np.array_equal(back.vectors, model.vectors) and np.allclose(back.weights, model.weights)
    make = meaning.Meaning(spark, model)
    assert make == meaning.Meaning(spark, back) and hash(make) == hash(meaning.Meaning(spark, back))
    rows = {r["id"]: r["vector"] for r in embedded(texts, make, 24).collect()}
    assert rows[-1] == rows[-2] == [0.0] * 24 and abs(sum(x * x for x in rows[0]) - 1) < 1e-5


def test_decomposition_is_that_of_the_matrix(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(40, 5))
    whole = a @ a.T
    rows = spark.createDataFrame([(i, j, float(whole[i, j])) for i in range(40) for j in range(40)], "i int, j int, v double").repartition(3, "i").sortWithinPartitions("i", "j")
    thin = r.normal(size=(40, 7))
    assert np.allclose(meaning.product(rows, thin), whole @ thin)


def test_pairs_and_edges(spark, monkeypatch):
    docs = spark.createDataFrame([("a b, c A",), (None,), ("",), ("b c",), ("zz",)], "text string")
    monkeypatch.setattr(meaning, "HELD", 1)
    assert dict(meaning.vocabulary(meaning.word_counts(docs), 9)) == {"a": 2, "b": 2, "c": 2}
    got = {(r["i"], r["j"]): r["n"] for r in meaning.near_pairs(docs, ["a", "b", "c"], 2).collect()}
    assert got == {(0, 1): 2 + 1, (1, 2): 2 + 2, (0, 2): 2 + 1}  # a b, b c, c A next to each other; a c and b A with one between
    small = meaning.train(docs, dim=8)
    assert small.dim == 8 and len(small.words) == 3 and np.isfinite(small.vectors).all()
    with pytest.raises(ValueError):
        meaning.train(docs.limit(0))
    with pytest.raises(ValueError):
        meaning.train(docs, dim=1 << 23)


def test_learn_index_and_search(spark, tmp_path, capsys):
    """A query finds texts that have none of its words."""
    root, model, folder = tmp_path / "tree", str(tmp_path / "model"), str(tmp_path / "ix")
    root.mkdir()
    for i, text in corpus(240):
        (root / f"{i}.txt").write_text(text)
    for t in range(TOPICS):
        (root / f"only{t}.txt").write_text(f"right{t}x0 right{t}x1 right{t}x2")
    assert cli.main(["learn", str(root), model, "--dim", "24"], spark) == 0 and "24 components" in capsys.readouterr().out
    assert cli.main(["index", str(root), folder, "--model", model], spark) == 0 and json.loads(capsys.readouterr().out)["config"]["dim"] == 24
    assert cli.main(["search", folder, "left3x0 left3x1", "-k", "40", "--model", model], spark) == 0
    assert "only3.txt" in capsys.readouterr().out
