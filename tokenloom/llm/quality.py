"""Operator 10: quality classifier, an ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 of poor quality, 2 good. P(grade > j) = sigmoid(w.x - theta_j) with weights shared
by both ordered thresholds; x are hashed words, hashed beginnings of words and measures of form, see
features(). It is fitted on the driver on a bounded sample of the labelled documents: those with the
smallest hash of doc_id, at most SAMPLE of them and SAMPLE_BYTES of text (all, if there are fewer); each
with all of its features. All texts are scored whole.

A null or empty text has the prior's score. Rows of `labels` with a null in any column, or of
documents that aren't there, don't train and take no room in the sample; repeated labels train each. Without
labels every score is that of grade 2 with certainty, so nothing is rejected. Where docs has columns of
the names that score() adds, score() replaces them; select_good() adds none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, U, _M2, blocks, byte_view, mix, placed_words

#: Features of hashed words, and of the text's form.
WORDS, FORM = 1 << 18, 16
SAMPLE, SAMPLE_BYTES = 20_000, 80 << 20
#: Besides the whole word, this many leading bytes are a feature, which inflected and compound forms share.
PREFIX = 4
NAMES = ("expected_grade", "p_not_toxic", "p_good")
_CLASS = np.full(256, 5, np.uint8)  # 5: bytes of other characters
_CLASS[:128] = 4  # signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_STRIP = np.arange(256, dtype=np.uint8)
for _c in b".,;:!?\"'()[]*#%&@":
    _STRIP[_c] = 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document, column, value): each distinct word and each distinct beginning of a longer
    word, with its damped count over the root of the row's length, and FORM dense columns: shares of
    character classes, capitals, repeated words, line breaks, word length, text length."""
    n = len(off) - 1
    data_of_words = _STRIP[data]
    w, woff, start, end = placed_words(data_of_words, off)
    doc = np.repeat(np.arange(n), np.diff(woff))
    col = (w >> U(46)).astype(np.int64)
    long = end - start > PREFIX
    head = np.zeros(int(long.sum()), U)
    for i in range(PREFIX):
        head |= _LOWER[data_of_words[start[long] + i]].astype(U) << U(8 * i)
    cells, times = np.unique(np.concatenate([doc * WORDS + col, doc[long] * WORDS + (mix(head + _M2) >> U(46)).astype(np.int64)]), return_counts=True)
    cdoc, ccol = cells // WORDS, cells % WORDS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(cdoc, value * value, n))
    value = value / np.sqrt(norm[cdoc])  # between counts and unit length: one word in a long text still tells

    size = np.diff(off)
    bdoc = np.repeat(np.arange(n), size)
    kinds = np.bincount(bdoc * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6) / np.maximum(size, 1)[:, None]
    nw = np.diff(woff)
    different = np.bincount(np.unique(doc * WORDS + col) // WORDS, minlength=n)
    lines = np.bincount(bdoc[data == 10], minlength=n)
    marks = np.bincount(bdoc[(data == 46) | (data == 44)], minlength=n)
    nn = np.maximum(nw, 1)
    dense = np.stack(
        [*kinds.T, different / nn, np.minimum(lines / nn * 5, 2), np.minimum(size / nn / 10, 3), np.log1p(nw) / 10, np.minimum(marks / nn * 5, 2),
         (kinds[:, 2] > 0.3), (kinds[:, 4] > 0.15), (different / nn < 0.3), (lines / nn > 0.2), np.ones(n)], 1,
    )
    r, c = np.nonzero(dense)
    rows, cols, vals = np.concatenate([cdoc, r]), np.concatenate([ccol, c + WORDS]), np.concatenate([value, dense[r, c]])
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], vals[order]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
        """P(grade > 0), P(grade > 1) of each of n documents."""
        eta = np.bincount(rows, vals * self.weights[cols], n)
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds, -40, 40)))


def gradient(w: np.ndarray, theta: np.ndarray, d: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted mean negative log-likelihood of grades y and its gradients by w and theta (first threshold,
    logarithm of the gap to the second); (d, c, x) are sparse rows."""
    n, gap = len(y), np.exp(theta[1])
    eta = np.bincount(d, x * w[c], n)
    a = 1 / (1 + np.exp(-np.clip(eta - theta[0], -40, 40)))  # P(> 0)
    b = 1 / (1 + np.exp(-np.clip(eta - theta[0] - gap, -40, 40)))  # P(> 1)
    p = np.maximum(np.choose(y, [1 - a, a - b, b]), 1e-9)
    da, db, share = a * (1 - a), b * (1 - b), weight / n
    by_eta = np.choose(y, [-da, da - db, db]) / p * share
    by_a = np.choose(y, [da, -da, 0 * da]) / p * share  # by theta_0 through a
    by_b = np.choose(y, [0 * db, db, -db]) / p * share
    return float(-(np.log(p) * share).sum()), -np.bincount(c, x * by_eta[d], len(w)), -np.array([by_a.sum() + by_b.sum(), by_b.sum() * gap])


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, epochs: int = 30, ridge: float = 1e-3) -> Model:
    """Maximum likelihood of the cumulative logits by Adam over shuffled batches of documents; the
    gap between the thresholds is exp(g), so they stay ordered. Classes weigh by 1/sqrt(frequency)."""
    n = len(grade)
    start = np.searchsorted(rows, np.arange(n + 1))
    w = np.zeros(WORDS + FORM)
    theta = np.array([-1.0, 0.0])  # first threshold, log gap
    weight = (1 / np.sqrt(np.maximum(np.bincount(grade, minlength=3), 1)))[grade]
    weight = weight / weight.mean()
    m, v, tm, tv, step = np.zeros_like(w), np.zeros_like(w), np.zeros(2), np.zeros(2), 0
    rng = np.random.default_rng(7)
    batch = max(64, n // 40)
    for epoch in range(epochs):
        rate = 0.05 * (1 - epoch / epochs) + 0.002
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            docs = order[lo : lo + batch]
            length = start[docs + 1] - start[docs]
            at = np.repeat(start[docs] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            _, grad, tg = gradient(w, theta, np.repeat(np.arange(len(docs)), length), cols[at], vals[at], grade[docs], weight[docs])
            grad += ridge * w
            step += 1
            for par, g, mm, vv in ((w, grad, m, v), (theta, tg, tm, tv)):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.999
                vv += 0.001 * g * g
                par -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Model(w, np.array([theta[0], theta[0] + np.exp(theta[1])]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model | None:
    """Fit on docs (doc_id, text) with labels (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(rated, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("grade"), F.col("size")]
    first = sized.orderBy(*order).limit(SAMPLE)  # a bounded number of rows, for one window and a broadcast
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sample = F.broadcast(first.withColumn("total", total).where(F.col("total") <= SAMPLE_BYTES).select("doc_id", "grade").distinct())
    joined = texts.join(sample, "doc_id").select("text", "grade", F.xxhash64("doc_id").alias("at"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = byte_view(b.column(0))
            grades, at = b.column(1), b.column(2)
            for lo, hi in blocks(off):
                r, c, v = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cut = np.searchsorted(r, np.arange(hi - lo + 1))
                cs, vs = c.astype("<i4"), v.astype("<f4")
                parts = [[x[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)] for x in (cs, vs)]
                yield pa.RecordBatch.from_arrays([at.slice(lo, hi - lo), grades.slice(lo, hi - lo), *(pa.array(x, pa.binary()) for x in parts)], ["at", "grade", "c", "v"])

    got = joined.mapInArrow(sparse, "at long, grade int, c binary, v binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("at", "ascending"), ("grade", "ascending"), ("c", "ascending")])  # the same fit for the same rows
    cols = np.frombuffer(b"".join(got["c"].to_pylist()), "<i4")
    vals = np.frombuffer(b"".join(got["v"].to_pylist()), "<f4")
    size = np.array([len(x) // 4 for x in got["c"].to_pylist()])
    return fit(np.repeat(np.arange(len(size), dtype=np.int32), size), cols, vals, got["grade"].to_numpy().astype(np.int64))


def _tails(model: Model | None, column: pa.Array) -> np.ndarray:
    p = np.ones((len(column), 2))
    if model is not None:
        data, off = byte_view(column)
        for lo, hi in blocks(off):
            p[lo:hi] = model.tails(*features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), hi - lo)
    return p


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of docs, with expected_grade, p_not_toxic = P(grade > 0) and p_good = P(grade > 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*(n for n in NAMES if n != text))
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _tails(shared.value, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1])], [*b.schema.names, *NAMES])

    return docs.mapInArrow(rows, docs.select("*", *(F.lit(0.0).alias(n) for n in NAMES)).schema)


def select_good(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs that the selection rule keeps, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_tails(shared.value, b.column(at))[:, 1] >= 0.5))

    return docs.mapInArrow(rows, docs.schema)


def rejects(p_not_toxic: str = "p_not_toxic", p_good: str = "p_good") -> F.Column:
    """The selection rule: a document goes if it is more likely toxic or poor than good."""
    return F.col(p_good) < 0.5
