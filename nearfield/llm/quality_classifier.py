"""Quality scores by positive-unlabelled learning.

Trusted documents are positives, the whole corpus is unlabelled. With the
squared loss the unbiased risk of a linear score f (du Plessis et al. 2015)

    prior * E_P[l(f)] + E_U[l(-f)] - prior * E_P[l(-f)],   l(z) = (1 - z)^2 / 4

needs nothing of the corpus but means of the features and of their products.
One pass gathers these over all documents, whatever their number; the
non-negative risk (Kiryo et al. 2017), which puts max(0, .) around the last two
terms, and its gradient are then exact. Features are what a text's bytes say
about its form: shares of pairs of character classes, repeats, lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import own, table
from nearfield.llm.text_bytes import slices

#: Labelled rows at most that a model is fitted on, the first by a hash of their id.
MOST_ROWS = 20_000
#: Bytes of texts that a task holds at a time; a longer text is held alone.
SLICE_BYTES = 2 << 20
#: Weight of the squared weights in the risk, each in units of its feature's mean square. It is 1 + FEW / positives times as large,
#: so that a few positives don't fit noise.
RIDGE, FEW = 0.02, 1000
#: Character classes: what each holds; every other byte of ASCII is a sign, all beyond it a letter.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "'\"()-", "#*$%&", "|<>", "/\\=_@+~^[]{}`")
_SIGN, _LETTER, _N = len(CLASSES), len(CLASSES) + 1, len(CLASSES) + 2
#: Bends of the extra measures: each also enters as max(0, x - bend).
BENDS = (0.1, 0.3, 0.6)
_MEASURES = 7
#: Numbers that describe a text, with the leading 1.
WIDTH = 1 + _N * _N + _MEASURES * (1 + len(BENDS))


def _class_of_bytes() -> np.ndarray:
    of = np.full(256, _SIGN, np.intp)
    of[128:] = _LETTER
    for k, members in enumerate(CLASSES):
        of[list(members.encode())] = k
    return of


_CLASS = _class_of_bytes()


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers for each text, from the bytes of all and their places."""
    out = np.zeros((len(at) - 1, WIDTH))
    out[:, 0] = 1.0
    classes = _CLASS[data]
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            own_classes = classes[a:b]
            pairs = np.bincount(own_classes[:-1] * _N + own_classes[1:], minlength=_N * _N)
            out[k, 1 : 1 + _N * _N] = np.sqrt(pairs / max(1, b - a - 1))
        m = _measures(data[a:b].tobytes())
        at_measures = 1 + _N * _N
        out[k, at_measures : at_measures + _MEASURES] = m
        for j, bend in enumerate(BENDS, 1):
            out[k, at_measures + j * _MEASURES : at_measures + (j + 1) * _MEASURES] = np.maximum(0.0, m - bend)
    return out


def _measures(raw: bytes) -> np.ndarray:
    """Between 0 and 1 each: word repeated at once, distinct words, repeated lines, words' and text's length, short text, words a line."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n = max(1, len(words))
    return np.array([
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, sum(map(len, words)) / n / 20),
        min(1.0, math.log1p(len(words)) / 12),
        1 / (1 + len(words)),
        min(1.0, len(lines) / n),
    ])


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Statistics:
    """Of the unlabelled and the positive texts: how many, and the sums of their features' products."""

    n_all: float
    all: np.ndarray
    n_positive: float
    positive: np.ndarray


def gather(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Statistics:
    """The statistics over every row of ``docs``; ``positives`` are at most MOST_ROWS values of doc_id, and are broadcast.

    A task sends two matrices of WIDTH x WIDTH. Those of all tasks are added in
    two rounds, so the driver gets one pair at any number of tasks.
    """
    rows = own(docs, doc_id=id_col, text=text_col)
    marked = rows.join(F.broadcast(positives.withColumn("trusted", F.lit(True))), "doc_id", "left").select("text", F.col("trusted").isNotNull().alias("trusted"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, WIDTH, WIDTH))
        for batch, data, at in slices(batches, "text", SLICE_BYTES):
            x = features(data, at)
            sums[0] += x.T @ x
            x = x[batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)]
            sums[1] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * WIDTH * WIDTH)
        for batch in batches:
            for value in batch.column("sums"):
                sums += np.frombuffer(value.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    parts = marked.mapInArrow(each, "sums binary")
    few = parts.repartition(16).mapInArrow(added, "sums binary")
    total = np.frombuffer(few.coalesce(1).mapInArrow(added, "sums binary").first()["sums"]).reshape(2, WIDTH, WIDTH)
    return Statistics(total[0, 0, 0], total[0], total[1, 0, 0], total[1])


def _solved(s: Statistics, b: np.ndarray, ridge: float) -> np.ndarray:
    """The weights w of (E_U[xx'] + ridge * diagonal) w = b, with the constant left free."""
    a = s.all / s.n_all
    ridge *= 1 + FEW / s.n_positive
    penalty = np.diag(a).copy() + 1e-9
    penalty[0] = 0.0
    return np.linalg.solve(a + ridge * np.diag(penalty) + 1e-12 * np.eye(len(a)), b)


def prior_of(s: Statistics, ridge: float = RIDGE) -> float:
    """Class prior from positives and unlabelled texts alone (Elkan and Noto 2008).

    A least-squares score of "is trusted" is, averaged over the trusted, the
    share of positives that is trusted; the trusted's share over it is the prior.
    """
    g = _solved(s, s.positive[0] / s.n_all, ridge)
    trusted = s.positive[0] @ g / s.n_positive
    return float(np.clip(s.n_positive / s.n_all / max(trusted, 1e-9), 0.01, 0.99))


def minimise(s: Statistics, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights by descent of the non-negative unbiased risk from zero.

    Newton's direction leads straight to the minimum of the unbiased risk, the
    solution w of one linear system. At t * w the last two terms of the risk are
    a quadratic in t, which begins at (1 - prior) / 4; where it would fall below
    zero, which an unbiased estimate does by overfitting or too large a prior,
    the descent ends: further down the method turns back.
    """
    p, u = s.positive / s.n_positive, s.all / s.n_all
    w = _solved(s, 2 * prior * p[0] - u[0], ridge)
    square, linear, constant = w @ (u - prior * p) @ w, 2 * (u[0] - prior * p[0]) @ w, 1 - prior
    roots = np.roots([square, linear, constant])
    ends = [float(r.real) for r in roots if abs(r.imag) < 1e-12 and r.real > 0]
    return w * min([1.0, *ends])


@dataclass
class QualityModel:
    """Weights of the features; the score is the share of positives that f stands for."""

    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of f, which estimates 2 * P(good) - 1: a smooth step that is 0.5 where f is 0 and keeps the order beyond -1 and 1."""
        f = np.clip(x @ self.weights, -20.0, 20.0)
        return 1 / (1 + np.exp(-4.0 * f))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS, prior: float | None = None, ridge: float = RIDGE
) -> QualityModel:
    """Learn from at most ``most_rows`` labelled rows that aren't held out, and from the texts of all documents.

    Labels of 1 make trusted positives; labels of 0 are not used. The class
    prior is estimated from the positives and the corpus, unless given. A
    document with several labels counts with the least of them.
    Without a positive, every score is 0 (or, without labels too, 0.5).
    """
    known = own(labels, doc_id=id_col, y=label_col).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = known.toArrow()  # at most most_rows pairs of numbers
    trusted = rows.column("y").to_numpy() > 0
    if not trusted.any():
        weights = np.zeros(WIDTH)
        weights[0] = -20.0 if len(trusted) else 0.0
        return QualityModel(weights, 0.0)
    positives = docs.sparkSession.createDataFrame(rows.filter(pa.array(trusted)).select(["doc_id"]))
    s = gather(docs, positives, id_col, text_col)
    if not s.n_positive:  # none of the labelled documents is there
        return QualityModel(np.zeros(WIDTH), 0.0)
    if prior is None:
        prior = prior_of(s, ridge)
    return QualityModel(minimise(s, prior, ridge), prior)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; a null text is scored like an empty one, null ids and repeated rows stay."""
    rows = own(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(data, at)))], names=["doc_id", "score"])

    return rows.mapInArrow(each, f"doc_id {kind}, score double")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
