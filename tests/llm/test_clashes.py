"""Columns with any name that an operator uses inside or adds, in lower and upper case, change nothing and stay as they were."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, centroids, importance, knn, licenses, media, packing, pii, simhash, substring, toxicity, url_filter

from .conftest import prose

SOURCES = [*(Path(corpus_pipeline.__file__).parent / "lodestone/llm").glob("*.py"), Path(corpus_pipeline.__file__)]
#: Every quoted word in the operators: all names of columns are among them.
NAMES = sorted({n.lower() for p in SOURCES for n in re.findall(r"[\"']([A-Za-z_][A-Za-z_0-9]{0,20})[\"']", p.read_text())} | {n.lower() for p in SOURCES for n in re.findall(r"\b(\w+) (?:long|int|string|binary|double|boolean|array<)", p.read_text())} | {f"c{i}" for i in range(4)} | {f"__c{i}" for i in range(4)})
TEXTS = [(i, prose(i % 7, 40)) for i in range(12)] + [(100 + i, f"{prose(50, 25)} {prose(i, 5)}") for i in range(3)] + [(200, None), (201, ""), (None, prose(1, 30))]


def wide(plain, case):
    have = {c.lower() for c in plain.columns}
    return plain.select("*", *[F.lit(f"own {n}").alias(case(n)) for n in NAMES if n not in have])


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2)


def test_many_names_are_tried():
    assert {"score", "predicted", "__id", "__hash", "__again", "__doc", "__row", "kept", "n_removed", "__hits", "spans", "carried", "row", "fp", "place", "weight", "rank"} <= set(NAMES)


def parted(got, rows):
    """The columns of ``rows`` in a result, and those that an operator added behind them."""
    n = len(rows.columns)
    plain = got.toDF(*[f"{i}" for i in range(len(got.columns))])
    assert got.columns[:n] == rows.columns
    return plain.select(*[F.col(f"{i}").alias(c) for i, c in enumerate(rows.columns)]), plain.select(*[F.col(f"{i}").alias(c) for i, c in enumerate(got.columns) if i == rows.columns.index("doc_id") or i >= n])


def stays(got, rows):
    """Whether all columns of ``rows`` are there with their values."""
    own = [c for c in rows.columns if c.lower() not in ("doc_id", "text", "n_chars")]
    assert [c for c in got.columns if c in own] == own
    assert got.where(" OR ".join(f"NOT `{c}` <=> 'own {c.lower()}'" for c in own)).isEmpty()


@pytest.mark.parametrize("case", [str.lower, str.upper], ids=["lower", "upper"])
@pytest.mark.parametrize("stage", range(3), ids=["toxic", "near", "passages"])
def test_stages(spark, plain, tmp_path, stage, case):
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = wide(plain, case)
    run = corpus_pipeline.STAGES[stage][1]
    got = run(spark, rows, str(tmp_path)).cache()
    assert got.columns == rows.columns
    stays(got, rows)
    assert Counter(map(tuple, got.select("doc_id", "text").collect())) == Counter(map(tuple, run(spark, plain, str(tmp_path)).select("doc_id", "text").collect()))


OPERATORS = {
    "bpe": bpe.encoded, "simhash": simhash.near_duplicates, "media": lambda d: media.described(media.read_archives(media.write_archives(d))).drop("path"), "packing": lambda d: packing.packed(d).drop("sequence_id", "offset"),
    "licenses": lambda d: licenses.scan(d, licenses.fit([["word"]])), "pii": pii.detected, "importance": lambda d: importance.resampled(d, d, percent=50).drop("rank"),
    "urls": lambda d: url_filter.judge(d, url_filter.rules_table(d.sparkSession), "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(plain, name):
    run = OPERATORS[name]
    assert Counter(map(repr, run(wide(plain, str.upper)).collect())) == Counter(map(repr, run(plain).collect()))


@pytest.mark.parametrize("case", [str.lower, str.upper], ids=["lower", "upper"])
def test_operators_that_add_columns(plain, case):
    rows = wide(plain, case)
    model = toxicity.train(plain, plain.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    own, scored = parted(toxicity.scored(rows, model), rows)
    stays(own, rows)
    own, less = parted(substring.without_repeats(rows), rows)
    stays(own, rows)
    stays(pii.redacted(rows), rows)
    assert scored.columns == ["doc_id", "score", "predicted"] and less.columns == ["doc_id", "kept", "n_words", "n_removed", "kept_sha256", "spans"]
    assert Counter(map(tuple, scored.select("doc_id", "score", "predicted").collect())) == Counter(map(tuple, toxicity.scored(plain, model).select("doc_id", "score", "predicted").collect()))
    assert Counter(map(tuple, less.select("doc_id", "kept", "n_removed").collect())) == Counter(map(tuple, substring.without_repeats(plain).select("doc_id", "kept", "n_removed").collect()))


@pytest.mark.parametrize("case", [str.lower, str.upper], ids=["lower", "upper"])
def test_vectors(spark, case):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    more = wide(rows, case)
    assert Counter(map(tuple, centroids.clustered(more, 3, dim=2).collect())) == Counter(map(tuple, centroids.clustered(rows, 3, dim=2).collect()))
    top = lambda x: Counter(map(tuple, knn.top_k(knn.whole(x), knn.whole(x).where("vec_id % 10 = 0"), 3).collect()))
    assert top(more) == top(rows)
