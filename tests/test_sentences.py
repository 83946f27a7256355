"""Sentence ends learned without labels, against planted ones in four languages and the plain pattern."""

import random

import pytest

from lodestone.functions import sentences
from lodestone.operators import chunking

#: Words, names and abbreviations (those that stand before a name or in the midst, and those that may end a sentence) by language.
TONGUES = {
    "en": ("the of and to in it was for on that with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know", "Smith Jones Miller London Paris Texas", "Dr. Mr. e.g. i.e. vs. approx.", "etc."),
    "de": ("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine", "Müller Schmidt Österreich Ärzte Köln", "Dr. z.B. bzw. ca. Nr.", "usw."),
    "fr": ("le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier vouloir déjà grand mon me moins aucun lui temps très savoir falloir voir quelque sans raison notre dont non an monde jour", "Dupont Émile Lyon École Genève", "M. Mme. p.ex. env. cf.", "etc."),
    "es": ("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada", "García Ávila Álvarez Madrid Ángel", "Sr. Dra. p.ej. aprox. pág.", "etc."),
}


def written(tongue, seed, n):
    r = random.Random(f"{tongue}{seed}")
    words, names, inner, last = (x.split() for x in TONGUES[tongue])
    out = []
    for _ in range(n):
        s = [r.choice(words) for _ in range(r.randint(6, 16))]
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randint(1, len(s) - 1)
            s[at:at] = [r.choice(inner), r.choice(names) if r.random() < 0.6 else r.choice(words)]
        if r.random() < 0.15:
            s[3:3] = [last[0]] if r.random() < 0.5 else []
        if r.random() < 0.1:
            s[2:2] = [f"{r.choice('ABCJ')}.", r.choice(names)]
        if r.random() < 0.2:
            s[1:1] = [r.choice(["3.5", "1,200", "17"])]
        s[0] = s[0][0].upper() + s[0][1:] if r.random() < 0.85 else r.choice(names)
        end = r.choice([".", ".", ".", ".", "?", "!"])
        out.append(" ".join(s) + (" " + last[0] if r.random() < 0.06 else end))
    return out


def f1(cut, truth):
    """By where sentences end in the text, white space apart."""
    def ends(parts):
        at, found = 0, set()
        for p in parts:
            at += len("".join(p.split()))
            found.add(at)
        return found

    right = found = wanted = 0
    for own in truth:
        a, b = ends(cut(" ".join(own))), ends(own)
        right, found, wanted = right + len(a & b), found + len(a), wanted + len(b)
    return 2 * right / (found + wanted)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, " ".join(written(t, i, 20))) for t in TONGUES for i in range(60)]
    return sentences.train(spark.createDataFrame([*rows, ("en", None), ("en", ""), ("en", "...")], "lang string, text string").repartition(4))


@pytest.mark.parametrize("tongue", TONGUES)
def test_planted_boundaries(model, tongue):
    truth = [written(tongue, 1000 + i, 15) for i in range(30)]
    trained, plain = f1(model, truth), f1(chunking.sentences, truth)
    assert trained > 0.97 and trained > plain, (tongue, trained, plain)


def test_single_texts(model):
    assert model("He saw Dr. Smith. It was late, e.g. This is one.") == ["He saw Dr. Smith.", "It was late, e.g. This is one."]
    assert model("Er kam. Ärzte waren da.\n\nund mehr") == ["Er kam.", "Ärzte waren da.", "und mehr"]
    assert model("Really?! (Yes.) “No.” J. Smith came... and went. 3.5 of them") == ["Really?!", "(Yes.)", "“No.”", "J. Smith came... and went.", "3.5 of them"]
    assert model("") == [] and model(" \n ") == [] and model("one") == ["one"]
    long = "word " * 50_000 + "e.g. x. " * 10_000
    assert "".join(" ".join(model(long)).split()) == "".join(long.split())


def test_untrained_and_small(spark):
    assert sentences.train(spark.createDataFrame([], "text string")) == sentences.Model()
    assert sentences.train(spark.createDataFrame([("No stop here",), (None,)], "text string")) == sentences.Model()
    assert sentences.Model()("One. Two? three. Four") == ["One.", "Two? three.", "Four"]


def test_chunks_follow_the_trained_ends(spark, model):
    text = "He saw Dr. Smith at home today. It was late."
    rows = spark.createDataFrame([(text,), (None,)], "text string")
    settings = chunking.Settings(7, 0)
    got = [[c["text"] for c in r["chunks"]] for r in chunking.chunked(rows, settings, cut=model).collect()]
    assert sorted(got) == [[], ["He saw Dr. Smith at home today.", "It was late."]]
