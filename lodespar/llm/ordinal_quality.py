"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with ordered thresholds and one
weight vector for all grades. x is the mean over a text's words of hashed
features: the word, its ending, its shape (letter case, digits, marks), and
per text how much of it repeats. A text's results are its expected grade and
the tail probability P(grade >= g) that selection uses.

Edge cases: null and empty texts have no word feature, only those of the whole
text; a text of any length is read whole. Labelled rows with a null grade or id
are not used. A probability of just the least one asked for keeps a document. With fewer than two
grades among the labels the model knows one grade: its expected grade is that
one, its tail probability 1. Rows repeat as given; other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _util
from ._words import U, Words, buffer, mix

BITS = 18
#: Bounds of the labelled rows that a model is fitted on: by grade, over all grades, and of their texts' bytes by grade.
MAX_ROWS, MAX_ALL, MAX_BYTES = 2000, 20_000, 32 << 20
#: Parts of a grade that are ranked apart before they are ranked together.
PARTS = 16
OUT = "struct<expected_grade:double,tail:double>"

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 4


def _or_by_word(bits: np.ndarray, w: Words) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(bits)))
    return total[w.end] - total[w.start]


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the hashed features, and the number of rows' words."""
    raw, offs = buffer(col)
    w = Words(raw, offs)
    rows = len(offs) - 1
    kind = _CLASS[raw]
    length = w.end - w.start
    upper, digit, mark = (_or_by_word(kind == k, w) for k in (1, 2, 4))
    shape = ((upper == length) * 1 + (upper == 1) * 2 + (upper > 1) * 4 + (digit > 0) * 8 + np.minimum(mark, 4) * 16 + np.minimum(length, 12) * 128).astype(U)
    h = w.hashes()
    mask = U((1 << bits) - 1)
    groups = (mix(h + U(1)), mix(w.span_hash(np.maximum(w.start, w.end - 3), w.end) + U(2)), mix(shape + U(3 << 40)))
    n = np.maximum(w.counts, 1)
    row = np.tile(w.doc, 3)
    index = (np.concatenate(groups) & mask).astype(np.int64)
    value = np.tile(1.0 / n[w.doc], 3)
    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    kinds = np.bincount(w.doc[order][new], minlength=rows)
    whole = np.stack((np.minimum(np.log2(w.counts + 1), 15).astype(np.int64), 32 + (10 * kinds) // n, 64 + (10 * kinds) // n + 16 * np.minimum(np.log2(w.counts + 1), 15).astype(np.int64)))
    index = np.concatenate((index, (mix(whole.astype(U).ravel() + U(5 << 41)) & mask).astype(np.int64)))
    return np.concatenate((row, np.tile(np.arange(rows), 3))), index, np.concatenate((value, np.full(3 * rows, 0.3))), w.counts


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """grades: the grades in order; weights; thresholds: one fewer than grades, rising."""

    def __init__(self, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def linear(self, col: pa.Array) -> np.ndarray:
        row, index, value, counts = features(col)
        return np.bincount(row, self.weights[index] * value, len(counts))

    def results(self, col: pa.Array, grade: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of that grade or a higher one."""
        z = self.linear(col)
        above = _sigmoid(z[:, None] - self.thresholds)  # P(grade > k)
        expected = self.grades[0] + above @ np.diff(self.grades)
        k = int(np.searchsorted(self.grades, grade))
        tail = np.ones(len(z)) if k == 0 else np.zeros(len(z)) if k == len(self.grades) else above[:, k - 1]
        return expected, tail


def fit_rows(texts: pa.Array, y: np.ndarray, rounds: int = 250, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; the thresholds are a first one plus exponentials, so they stay in order."""
    grades, k = np.unique(y, return_inverse=True)
    if len(grades) < 2:
        return Model(grades.astype(float) if len(grades) else np.zeros(1), np.zeros(1 << BITS), np.zeros(0))
    # pieces of about a megabyte of text each; all steps go piece by piece, so memory holds 12 bytes a feature and little else
    pieces: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    size, done = 1 << BITS, 0
    for piece in _util.steps(iter([pa.record_batch([texts], names=["t"])]), "t"):
        r, i, v, counts = features(piece.column(0))
        u, inv = np.unique(r * size + i, return_inverse=True)
        pieces.append((done, done + len(counts), (u >> BITS).astype(np.int32), (u & (size - 1)).astype(np.int32), np.bincount(inv, v, len(u)).astype(np.float32)))
        done += len(counts)
    m, n = len(grades) - 1, len(y)
    share = np.cumsum(np.bincount(k))[:-1] / n
    start = np.log(share / (1 - share))
    theta = np.concatenate((np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    mean, var, g, z = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta), np.zeros(n)
    weight = (n / (len(grades) * np.bincount(k)))[k]  # each grade counts the same in all
    for step in range(1, rounds + 1):
        w, t = theta[:size], np.cumsum(np.concatenate((theta[size : size + 1], np.exp(theta[size + 1 :]))))
        for lo, hi, row, index, value in pieces:
            z[lo:hi] = np.bincount(row, w[index] * value, hi - lo)
        upper = np.where(k < m, _sigmoid(np.append(t, 0)[np.minimum(k, m)] - z), 1.0)
        lower = np.where(k > 0, _sigmoid(np.append(t, 0)[np.maximum(k - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight / n, lower * (1 - lower) / p * weight / n
        gz = du - dl
        gt = np.bincount(k, -du, m + 1)[:m] + np.bincount(np.maximum(k - 1, 0), dl, m + 1)[:m]
        np.multiply(w, ridge, out=g[:size])
        for lo, hi, row, index, value in pieces:
            g[:size] += np.bincount(index, gz[lo:hi][row] * value, size)
        tail = np.cumsum(gt[::-1])[::-1]
        g[size] = tail[0]
        g[size + 1 :] = tail[1:] * np.exp(theta[size + 1 :])
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta -= rate * min(1, 3 * (1 - step / rounds)) * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return Model(grades.astype(float), theta[:size].copy(), np.cumsum(np.concatenate((theta[size : size + 1], np.exp(theta[size + 1 :])))))


def fit(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: doc_id, text; ratings: doc_id, grade.

    Of each grade the max_rows rows with the smallest hash of the id are used,
    fewer where there are so many grades that these would be more than MAX_ALL,
    and of these those whose texts, in that order, have MAX_BYTES or less
    together. A document with several ratings keeps the highest; of several
    texts with one id the longest is used.
    """
    spark = docs.sparkSession
    _util.ship(spark)
    known = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("double").alias("grade")).withColumn("h", F.xxhash64(F.lit("quality"), "doc_id"))
    known = _util.cut(known)
    grades = known.agg(F.count_distinct("grade")).first()[0]
    each = max(1, min(max_rows, MAX_ALL // max(grades, 1)))
    # within parts of a grade first, so that no task reads all of its rows
    picked = known.withColumn("part", F.pmod("h", F.lit(PARTS)))
    for by in (("grade", "part"), ("grade",)):
        picked = picked.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("n") <= each).drop("n")
    picked = picked.drop("part")
    sample = _util.sample_texts(docs, picked, "grade", MAX_BYTES).select("doc_id", "grade", "text").toArrow().sort_by([("doc_id", "ascending")])
    return fit_rows(pa.chunked_array(sample.column("text").chunks, sample.schema.field("text").type).combine_chunks(), sample.column("grade").to_numpy())


def results(model: Model, text: Column, spark, grade: float) -> Column:
    """A struct of the expected grade and the probability of grade or more."""
    _util.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(col: pa.Array) -> pa.Array:
        parts = [shared.value.results(p.column(0), grade) for p in _util.steps(iter([pa.record_batch([col], names=["t"])]), "t")]
        cols = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0) for j in (0, 1)]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["expected_grade", "tail"])

    return F.arrow_udf(run, OUT).asNondeterministic()(text)


def grade_labels(labels: DataFrame) -> DataFrame:
    """Ratings from the labels of quality and toxicity: 0 poor; 1 good but toxic; 2 good. Null quality gives none; null toxic counts as not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def select_documents(docs: DataFrame, model: Model, text_col: str = "text", grade: float = 1, least: float = 0.5) -> DataFrame:
    """The rows of docs whose probability of that grade or more is at least the given one, with docs' own columns."""
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    text = F.col(f"__c{names.index(text_col)}")
    kept = inner.withColumn("__q", results(model, text, docs.sparkSession, grade)).where(F.col("__q.tail") >= least).drop("__q")
    return kept.toDF(*names)
