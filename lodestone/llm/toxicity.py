"""A convolutional text classifier for toxicity, trained in numpy.

Words are hashed to buckets; buckets that enough training texts use have an embedding, all others count as zero.  Filters
of several widths run over the word sequence, each filter's largest value over the whole text (of any length) is
its feature, and a logistic layer weighs these.  As a filter is linear, its part for each bucket is
looked up in a table, and a text costs one row of the tables for each word.

Thresholds are calibrated by language on labelled texts kept out of the fitting; the language is
guessed from function words of the text itself.  A score is shifted so that its language's threshold becomes 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, numbered_columns, small_batches, table, with_added, with_names, written

BUCKETS = 1 << 18
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 8
PAD = max(WIDTHS) - 1
#: Training and calibration take at most so many labelled ids, those with the smallest hashes; in this order each id's text is
#: taken whole where so many words together still have room for it.  Others are left out alone.
SAMPLE, SAMPLE_WORDS = 12_000, 12_000_000
#: Buckets with an embedding are those that so many training texts use.
LEAST_TEXTS = 5
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
START = 0.3
CALIBRATION = 5  # one in so many labelled texts

#: Frequent function words that tell the languages of the corpus apart.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "was", "it"),
    "fr": ("le", "la", "les", "et", "des", "est", "que", "une", "dans", "pour"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "mit", "den", "von"),
    "es": ("el", "los", "las", "y", "que", "una", "con", "por", "para", "del"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
WORD = re.compile(r"\w+")


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


class Words(dict):
    """word -> the row of its bucket among the embeddings, 0 if none; emptied now and then."""

    def __init__(self, rows: np.ndarray):
        super().__init__()
        self.rows = rows

    def __missing__(self, word: str) -> int:
        self[word] = row = int(self.rows[bucket(word)])
        return row


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


_LANGUAGE_OF = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words:
        _LANGUAGE_OF.setdefault(_w, []).append(_i)


def language(words: list[str]) -> int:
    """Index in LANGUAGES of the language with most function words; the first of equals."""
    counts = [0] * len(FUNCTION_WORDS)
    for w in words:
        for i in _LANGUAGE_OF.get(w, ()):
            counts[i] += 1
    best = max(counts)
    return counts.index(best) if best else len(FUNCTION_WORDS)


@dataclass
class Model:
    rows: np.ndarray  # bucket -> row of the embeddings
    embedding: np.ndarray  # rows x DIM; row 0 is zero and stays so
    filters: list[np.ndarray]  # width x DIM x FILTERS for each width
    bias: np.ndarray  # of all filters
    weights: np.ndarray  # of the features
    intercept: float
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))  # thresholds' log odds by language

    def tables(self) -> list[np.ndarray]:
        """For each width: width x rows x FILTERS."""
        return [np.einsum("rd,wdf->wrf", self.embedding, f).astype(np.float32) for f in self.filters]


#: Words are convolved in pieces of at most so many, that share their ends, so memory doesn't follow a text's length.
PIECE = 1 << 15


def pooled(tables: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter over one text, and where it was; the text has PAD zeros around it."""
    ids = np.concatenate([np.zeros(PAD, np.int64), ids, np.zeros(PAD, np.int64)])
    top, where = [], []
    for t in tables:
        n = len(ids) - len(t) + 1
        best, at = None, None
        for a in range(0, n, PIECE):
            b = min(n, a + PIECE)
            value = t[0][ids[a:b]].copy()
            for j in range(1, len(t)):
                value += t[j][ids[a + j : b + j]]
            i = value.argmax(0)
            v = value[i, np.arange(value.shape[1])]
            if best is None:
                best, at = v, a + i
            else:
                more = v > best
                best, at = np.where(more, v, best), np.where(more, a + i, at)
        top.append(best)
        where.append(at)
    return np.concatenate(top), np.concatenate(where)


def useful(ids: np.ndarray) -> np.ndarray:
    """Shortens stretches of words without an embedding to PAD + 1 of them: no filter's largest value changes."""
    if len(ids) <= PAD + 1:
        return ids
    zero = ids == 0
    run = np.concatenate([[0], np.cumsum(zero)])
    keep = np.ones(len(ids), bool)
    w = PAD + 2
    keep[w - 1 :] = (run[w:] - run[:-w]) < w
    return ids[keep]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the log loss; ``texts`` are buckets.  Of each filter only the winning words get a gradient."""
    rng = np.random.default_rng(seed)
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for h, y in zip(texts, labels.tolist(), strict=True):
        own = np.unique(h)
        seen[own] += 1
        if y:
            toxic[own] += 1
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    ones = labels.sum()
    ratio = np.log((toxic[used] + 0.5) / (ones + 1)) - np.log((seen[used] - toxic[used] + 0.5) / (len(labels) - ones + 1))
    weight = ratio * seen[used] / (seen[used] + LEAST_TEXTS)
    rows = np.zeros(BUCKETS, np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    gap = np.zeros(PAD, np.int64)
    ids = [np.concatenate([gap, useful(rows[h].astype(np.int64)), gap]) for h in texts]
    total = FILTERS * len(WIDTHS)
    share = (labels.sum() + 1) / (len(labels) + 2)
    p = {"b": np.zeros(total), "w": rng.normal(0, 0.3, total), "c": np.array([np.log(share / (1 - share))])}
    p |= {f"f{w}": rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)) for w in WIDTHS}
    e = rng.normal(0, 0.1, (len(used) + 1, DIM)).astype(np.float32)
    # the first component begins at the bucket's log odds of the label, and half of the filters look for it
    e[1:, 0] = START * weight
    for w in WIDTHS:
        p[f"f{w}"][:, 0, : FILTERS // 2] = 1
    p["w"] = np.where(np.arange(total) % FILTERS < FILTERS // 2, np.abs(p["w"]), p["w"])
    e[0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (p | {"e": e}).items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            row = np.concatenate([ids[i] for i in own])
            ends = np.cumsum([len(ids[i]) for i in own])
            words, place = np.unique(row, return_inverse=True)
            value, where = np.empty((len(own), total)), np.empty((len(own), total), np.int64)
            for n, w in enumerate(WIDTHS):
                part = slice(n * FILTERS, (n + 1) * FILTERS)
                filters = np.concatenate(list(p[f"f{w}"]), 1)
                tables = (e[words] @ filters).astype(np.float32)
                sums = tables[place[: len(row) - w + 1], :FILTERS].copy()
                for j in range(1, w):
                    sums += tables[place[j : len(row) - w + 1 + j], j * FILTERS : (j + 1) * FILTERS]
                for r, end in enumerate(ends.tolist()):
                    begin = end - len(ids[own[r]])
                    v = sums[begin : end - w + 1]
                    i = v.argmax(0)
                    where[r, part] = begin + i
                    value[r, part] = v[i, np.arange(FILTERS)]
            value += p["b"]
            active = np.maximum(value, 0)
            error = (sigmoid(active @ p["w"] + p["c"][0]) - labels[own]) / len(own)
            g = {"w": active.T @ error, "c": np.array([error.sum()])}
            back = error[:, None] * p["w"] * (value > 0)
            g["b"] = back.sum(0)
            hit, push = [], []
            for n, w in enumerate(WIDTHS):
                part = slice(n * FILTERS, (n + 1) * FILTERS)
                d = back[:, part]
                g[f"f{w}"] = np.empty_like(p[f"f{w}"])
                for j in range(w):
                    word = row[where[:, part] + j]
                    g[f"f{w}"][j] = np.einsum("bfd,bf->df", e[word], d)
                    hit.append(word.ravel())
                    push.append((d[:, :, None] * p[f"f{w}"][j].T[None]).reshape(-1, DIM))
            touched, to = np.unique(np.concatenate(hit), return_inverse=True)
            ge = np.zeros((len(touched), DIM), np.float32)
            np.add.at(ge, to, np.concatenate(push).astype(np.float32))
            step += 1
            for k, x in p.items():
                m, v = moments[k]
                grad = g[k] + DECAY * x
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            # all embeddings decay, at Adam's even pace: those that win no filter soon hover around zero
            m, v = moments["e"]
            grad = DECAY * e
            grad[touched] += ge
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            e -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v * (1 / (1 - 0.999**step))) + 1e-8)
            e[0] = 0
    return Model(rows, e.astype(np.float32), [p[f"f{w}"].astype(np.float32) for w in WIDTHS], p["b"], p["w"], float(p["c"][0]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.tables, self.known = model, model.tables(), Words(model.rows)

    def log_odds(self, rows: np.ndarray) -> float:
        value, _ = pooled(self.tables, useful(rows))
        return float(np.maximum(value + self.model.bias, 0) @ self.model.weights + self.model.intercept)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if len(self.known) > 400_000:
            self.known.clear()
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return float(sigmoid(self.log_odds(rows) - self.model.shifts[language(words)]))


def threshold(odds: np.ndarray, labels: np.ndarray) -> float:
    """The log odds that part the labels with the best F1, drawn towards zero where few labels tell it."""
    if not len(odds) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-odds)
    odds, labels = odds[order], labels[order]
    hits = np.cumsum(labels)
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + labels.sum())
    i = int(f1.argmax())
    best = odds[i] if i + 1 == len(odds) else (odds[i] + odds[i + 1]) / 2
    return float(best * labels.sum() / (labels.sum() + 20))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled texts of at most SAMPLE_WORDS words together; ids, languages and sources play no part in it.

    Without labels of both kinds the model gives every text the same score.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(2).to_pylist()]
            ids = [np.array([bucket(w) for w in x], "<u4").tobytes() for x in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([language(x) for x in words], pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "label", "tongue", "ids"])

    numbers = written(rows.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(hashed, "doc_id long, label int, tongue int, ids binary"), "labelled-texts")
    numbers = numbers.withColumn("hash", F.xxhash64("ids"))
    # of an id with several texts one counts; sizes of at most ``sample`` texts tell which come to the driver
    one = numbers.groupBy("doc_id").agg(F.min(F.struct("hash", F.octet_length("ids").alias("bytes"))).alias("one"))
    total, picked = 0, []
    for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r["one"]["bytes"] // 4 <= SAMPLE_WORDS:
            total += r["one"]["bytes"] // 4
            picked.append((r["doc_id"], r["one"]["hash"]))
    these = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, hash long"))
    kept = numbers.join(these, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().to_pylist()
    dropped(numbers)
    marks = np.array([r["label"] for r in kept], float)
    texts = [np.frombuffer(r["ids"], "<u4").astype(np.int32) for r in kept]
    tongues = np.array([r["tongue"] for r in kept])
    if not len(marks) or marks.min() == marks.max():
        base = float(marks.mean()) if len(marks) else 0.0
        n = FILTERS * len(WIDTHS)
        return Model(np.zeros(BUCKETS, np.int32), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n), np.zeros(n), float(np.log((base + 1e-3) / (1 - base + 1e-3))))
    apart = np.arange(len(texts)) % CALIBRATION == 0
    model = fit([t for t, x in zip(texts, apart, strict=True) if not x], marks[~apart])
    scorer = Scorer(model)
    odds = np.array([scorer.log_odds(model.rows[t].astype(np.int64)) for t, x in zip(texts, apart, strict=True) if x])
    every = threshold(odds, marks[apart])
    for i in range(len(LANGUAGES)):
        own = tongues[apart] == i
        model.shifts[i] = threshold(odds[own], marks[apart][own]) if marks[apart][own].sum() >= 20 else every
    return model


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (0 or 1) to all rows and columns of ``docs``, for each whole text.

    Null texts are empty ones and have the score of a text without words.  All columns of ``docs`` stay as they are, whatever their names; the operator's own are the last two.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    rows, plain, columns = numbered_columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shipped.value)
        for b in batches:
            s = np.array([own.score(t) for t in b.column(0).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*plain, "score", "predicted"])

    added = StructType.fromDDL("score double, predicted int")
    done = rows.select(columns["text"].alias("text"), *plain).mapInArrow(run, with_added(rows, plain, added))
    return done.select(*with_names(columns, added.names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
