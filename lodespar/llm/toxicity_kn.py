"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, give each letter of a word its probability
after up to ``ORDER - 1`` earlier letters of that word. Only the longest
history is counted by class; below it both classes share one chain of
Kneser-Ney continuation counts, so rare expressions that share a stem with
known ones are judged by the stem. A letter that no class has seen after a
history takes the shared probability from both sides, and what remains of the
comparison is the ratio of the two back-off weights.

The counts are taken over the whole texts of all labelled documents and all of
their words. A model needs no words, only their distinct runs of ORDER bytes
with how often each stands in texts of a class: of these there are far fewer
than words, and they are all that the driver takes.

The score of a text is a logistic function of length-normalised
log-likelihood differences: of the whole text by its letters, and of the
words that speak most for toxicity. It is calibrated on all labelled documents
by models that have not seen them; each step of its fit sums over their table.

Edge cases: null and empty texts have no word; their differences are 0 and
their score is what the calibration gives for that. Rows repeat as given; null
ids are kept. Of several labels with one id the higher counts, and each text
with that id has it. Without labels of both classes every score is 0. A word of
any length and a text of any length is read whole. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util
from ._rows import RowTable, find_rows
from ._words import U, Words, mix

#: Longest run of letters that is counted: the letter and its history.
ORDER = 6
DISCOUNT = 0.75
#: Log-likelihood difference of a word from which on it speaks for toxicity.
MARGIN = 2.0
#: Rows of counts that a task adds up before it sends them.
HELD = 1 << 19
FOLDS = 3

_GAP = np.ones(256, bool)
_GAP[ord("a") : ord("z") + 1] = False
_GAP[ord("A") : ord("Z") + 1] = False
_GAP[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BEGIN, _END = 1, 2  # bytes that stand in no word


def lower_words(col: pa.Array) -> Words:
    from ._words import buffer

    raw, offs = buffer(col)
    return Words(_LOWER[raw], offs, _GAP)


def _pack(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen words one after another, each between the marks of begin and end; and where each begins, and the last ends."""
    n = w.end[which] - w.start[which]
    offs = np.concatenate(([0], np.cumsum(n + 2)))
    out = np.empty(offs[-1], np.uint8)
    out[offs[:-1]], out[offs[1:] - 1] = _BEGIN, _END
    inside = np.ones(len(out), bool)
    inside[offs[:-1]] = inside[offs[1:] - 1] = False
    out[inside] = w.raw[np.repeat(w.start[which] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    return out, offs


def _letters(raw: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """For each letter after a word's begin mark: its place, and the word's number."""
    w = Words(raw, offs, np.zeros(256, bool))
    word = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    at = np.arange(len(raw), dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    keep = at > offs[word]
    return w, at[keep], word[keep]


def _grams(w: Words, at: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the run of at most n letters that ends at each place, and of its history."""
    lo = np.maximum(w.offs[word], at - n + 1)
    return w.span_hash(lo, at + 1), w.span_hash(lo, at)


def _sum(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    u, inv = np.unique(keys, return_inverse=True)
    return (u, *(np.bincount(inv, v, len(u)) for v in values))


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(keys, return_counts=True)
    return u, n.astype(float)


def _look(keys: np.ndarray, table: np.ndarray, values: np.ndarray, default: float = 0.0) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[i] == keys, values[i], default)


def _run_keys(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of packed words: for each letter after a begin mark the run of at most ORDER bytes that ends there, as a number of its bytes (none is 0), and the word's number."""
    _, at, word = _letters(raw, offs)
    keys = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        inside = at - k >= offs[word]
        keys[inside] |= raw[at[inside] - k].astype(np.int64) << 8 * k
    return keys, word


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each key's columns of counts."""
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.stack([np.bincount(inv, c, len(u)) for c in counts])


class Model:
    """Tables of the log ratio of a letter after its history: of seen runs, and of histories for runs that are not seen."""

    def __init__(self, words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray):
        raw = np.frombuffer(b"".join(bytes([_BEGIN]) + x + bytes([_END]) for x in words), np.uint8)
        keys, word = _run_keys(raw, np.concatenate(([0], np.cumsum([len(x) + 2 for x in words]))).astype(np.int64))
        self._fit(*_add(keys, np.stack((toxic[word], ordinary[word]))))

    @classmethod
    def of_runs(cls, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
        """keys: the distinct runs of the words, in rising order; toxic, ordinary: how often each stands."""
        out = cls.__new__(cls)
        out._fit(keys, np.stack((toxic, ordinary)))
        return out

    def _fit(self, keys: np.ndarray, counts: np.ndarray) -> None:
        # shorter runs are the ends of runs, so what distinct words give, distinct runs give too
        letters = keys.astype(">i8").view(np.uint8).reshape(-1, 8)
        offs = np.concatenate(([0], np.cumsum((letters > 0).sum(1)))).astype(np.int64)
        w = Words(letters[letters > 0], offs, np.zeros(256, bool))
        at, word = offs[1:] - 1, np.arange(len(keys))
        # shared continuation counts, from the shortest history up: each distinct run of n + 1 letters adds one to its run of n
        shared: tuple[np.ndarray, np.ndarray] | None = None
        lower = np.full(len(at), 1 / 256)
        for n in range(1, ORDER):
            longer = w.span_hash(np.maximum(w.offs[word], at - n), at + 1)
            gram, hist = _grams(w, at, word, n)
            hist = mix(hist + U(n))
            first = np.unique(longer, return_index=True)[1]
            del longer
            g, c = _count(gram[first])
            hk, hn = _count(hist[first])
            kinds = _look(hk, *_count(hist[first][np.unique(mix(mix(hist[first]) + gram[first]), return_index=True)[1]]))
            total = _look(hist, hk, hn, 1.0)
            lower = np.maximum(_look(gram, g, c) - DISCOUNT, 0) / total + DISCOUNT * _look(hist, hk, kinds) / total * lower
        gram, hist = _grams(w, at, word, ORDER)
        g, first = np.unique(gram, return_index=True)
        base, gh = lower[first], hist[first]
        logs, weights = [], []
        for count in counts:
            c = _sum(gram, count.astype(float))[1]
            hk, hn = _sum(gh, c)
            kinds = _sum(gh, (c > 0).astype(float))[1]
            back = np.where(hn > 0, DISCOUNT * kinds / np.maximum(hn, 1), 1.0)
            total = _look(gh, hk, hn)
            logs.append(np.log(np.where(total > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1), 0) + _look(gh, hk, back, 1.0) * base))
            weights.append(np.log(back))
        self.gram, self.gram_llr = g, (logs[0] - logs[1]).astype(np.float32)
        self.hist, self.hist_llr = hk, (weights[0] - weights[1]).astype(np.float32)

    def of_words(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The log-likelihood difference of each packed word."""
        w, at, word = _letters(raw, offs)
        gram, hist = _grams(w, at, word, ORDER)
        llr = _look(gram, self.gram, self.gram_llr, np.nan)
        missing = np.isnan(llr)
        llr[missing] = _look(hist[missing], self.hist, self.hist_llr)
        return np.bincount(word, llr, len(offs) - 1)

    def features(self, w: Words) -> np.ndarray:
        """Per row: the difference by letter over the whole text, the largest of a word, the sum of what words exceed MARGIN by (its logarithm), and the logarithm of the number of words, which the calibration needs to judge that sum."""
        rows = len(w.offs) - 1
        out = np.zeros((rows, 4))
        if not len(w.start):
            return out
        _, first, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
        llr = self.of_words(*_pack(w, first))[inv]
        letters = np.bincount(w.doc, w.end - w.start, rows)
        out[:, 0] = np.clip(100 * np.bincount(w.doc, llr, rows) / np.maximum(letters, 1), -50, 50)
        some = w.counts > 0
        out[some, 1] = np.minimum(np.maximum.reduceat(llr, w.first[:-1][some]), 20)
        out[:, 2] = np.log1p(np.bincount(w.doc, np.maximum(llr - MARGIN, 0), rows))
        out[:, 3] = np.log1p(w.counts)
        return out


def _sums(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gradient and negative second derivatives of the log-likelihood at t, in a row."""
    a = np.column_stack((np.ones(len(x)), x))
    p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
    return np.concatenate((a.T @ (y - p), ((a * (p * (1 - p))[:, None]).T @ a).ravel()))


def _logistic(sums: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
    """Ridge logistic regression by Newton steps, for few columns. sums: _sums over all rows, at some weights."""
    t = np.zeros(columns + 1)
    ridge = np.array([0.0] + [0.1] * columns)
    for _ in range(50):
        both = sums(t)
        h = both[columns + 1 :].reshape(columns + 1, columns + 1) + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, both[: columns + 1] - ridge * t)
        t += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return t


class Scorer:
    def __init__(self, model: Model | None, weights: np.ndarray | None):
        self.model, self.weights = model, weights

    def __call__(self, col: pa.Array) -> pa.Array:
        parts = []
        for piece in _util.steps(iter([pa.record_batch([col], names=["t"])]), "t"):
            if self.model is None:
                parts.append(np.zeros(piece.num_rows))
                continue
            f = self.model.features(lower_words(piece.column(0)))
            parts.append(1 / (1 + np.exp(-np.clip(self.weights[0] + f @ self.weights[1:], -30, 30))))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs: doc_id, text; labels: doc_id, toxic (others don't matter).

    The models count all labelled rows, dealt to FOLDS folds. The calibration
    learns from all of them: each fold is measured by models of the other folds.
    The models of the scorer take all folds.
    """
    spark = docs.sparkSession
    _util.ship(spark)
    docs = _util.steady(docs.select("doc_id", "text"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(FOLDS)).cast("int"))
    # each row's label by its number, so that no text is shuffled: 2 * fold + toxic
    marks = RowTable(docs.select("doc_id", F.monotonically_increasing_id().alias("row")).join(known, "doc_id").select("row", F.array((2 * F.col("fold") + F.col("toxic")).cast("bigint")).alias("to")))
    folder = marks.path

    def labelled(batches):
        for batch in _util.steps(batches, "text"):
            hit, _, label = find_rows(folder, batch.column("row").to_numpy())
            if hit.any():
                yield batch.column("text").filter(pa.array(hit)), label

    def count(batches):
        held, rows = [], 0

        def send(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(keys), *(pa.array(c.astype(np.int64)) for c in counts)], names=["run", *numbers])

        for text, label in labelled(batches):
            w = lower_words(text)
            _, first, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
            counts = np.bincount(inv * (2 * FOLDS) + label[w.doc], minlength=len(first) * 2 * FOLDS).reshape(-1, 2 * FOLDS).T
            keys, word = _run_keys(*_pack(w, first))
            held.append(_add(keys, counts[:, word]))
            rows += len(held[-1][0])
            if rows > HELD:
                held = [_add(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held], 1))]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield send(*held.pop())
                    rows = 0
        if held:
            yield send(*_add(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held], 1)))

    numbers = [f"n{k}" for k in range(2 * FOLDS)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    runs = rows.mapInArrow(count, "run bigint, " + ", ".join(f"{n} bigint" for n in numbers)).groupBy("run").agg(*[F.sum(n).alias(n) for n in numbers]).toArrow().sort_by("run")
    keys = runs.column("run").to_numpy()
    counts = np.stack([runs.column(n).to_numpy() for n in numbers])

    def model(folds: list[int]) -> Model | None:
        ordinary, toxic = (counts[[2 * f + k for f in folds]].sum(0) for k in (0, 1))
        if not toxic.sum() or not ordinary.sum():
            return None
        seen = np.flatnonzero(toxic + ordinary)
        return Model.of_runs(keys[seen], toxic[seen], ordinary[seen])

    final = model(list(range(FOLDS)))
    if final is None:
        marks.drop()
        return Scorer(None, None)
    others = {f: model([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)}
    shared = spark.sparkContext.broadcast(others)

    def measure(batches):
        for text, label in labelled(batches):
            for k, m in shared.value.items():
                mine = label // 2 == k
                if m is not None and mine.any():
                    f = m.features(lower_words(text.filter(pa.array(mine))))
                    yield pa.record_batch([pa.array((label[mine] % 2).astype(np.float64)), *(pa.array(f[:, j]) for j in range(4))], names=list("yabcd"))

    def step(t: np.ndarray) -> np.ndarray:
        def run(batches):
            out = np.zeros(5 + 25)
            for batch in batches:
                out += _sums(np.column_stack([batch.column(k).to_numpy() for k in "abcd"]), batch.column("y").to_numpy(), t)
            yield pa.record_batch([pa.array([out.tolist()])], names=["v"])

        # exact sums of one row a task, whatever their order
        return np.array([math.fsum(c) for c in zip(*[r.v for r in table.mapInArrow(run, "v array<double>").collect()])])

    table = _util.cut(rows.mapInArrow(measure, "y double, a double, b double, c double, d double"))
    marks.drop()
    n, toxic = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    weights = _logistic(step, 4) if 0 < toxic < n else np.array([-4.0, 0.0, 0.3, 1.5, -0.5])
    _util.drop_cut(table)
    return Scorer(final, weights)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every whole text as the column out, in place of one of that name."""
    _util.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(text: pa.Array) -> pa.Array:
        return shared.value(text)

    return docs.withColumn(out, F.arrow_udf(run, "double").asNondeterministic()(F.col(text_col)))
