"""Operator 6: language identification by multinomial naive Bayes over hashed character n-grams.

Characters are code points; A-Z count as a-z, and all that is ASCII but no letter is one symbol. N-grams of
three and four characters are hashed into 2**14 buckets. Training adds up the counts of all training rows by
language in one shuffle of (language, bucket). The matrix of log-probabilities is broadcast, for LANGS
languages at a time, so what is broadcast is bounded; scores go on from one part of the languages to the next.
Scoring multiplies sparse batch counts with it.

A null text, or one without letters, is `und` with score 0; rows without a language don't train.
Without any training row every text is `und`; a text without an n-gram goes by the priors. Ties go to the
language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, U, blocks, byte_view, materialize, mix

BUCKETS = 1 << 14
LANGS = 500
_SYMBOL = _LOWER.astype(np.uint32)
_SYMBOL[:65] = _SYMBOL[91:97] = _SYMBOL[123:128] = 32
_LEAD = np.zeros(256, np.uint32)  # the bits that a first byte gives to its code point, and how many bytes follow
_MORE = np.zeros(256, np.int64)
for _b in range(128, 256):
    _MORE[_b] = 3 if _b >= 0xF0 else 2 if _b >= 0xE0 else 1
    _LEAD[_b] = _b & (0x7 if _b >= 0xF0 else 0xF if _b >= 0xE0 else 0x1F)


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the characters of valid UTF-8, and n + 1 offsets by document."""
    first = (data & 0xC0) != 0x80
    at = np.flatnonzero(first)
    lead = data[at]
    x = _SYMBOL[lead]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        place, more = at[wide], _MORE[lead[wide]]
        code = _LEAD[lead[wide]]
        for i in (1, 2, 3):
            on = more >= i
            code[on] = code[on] << 6 | (data[place[on] + i] & 0x3F)
        x[wide] = code
    return x, np.concatenate([[0], np.cumsum(first)])[off]


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of three and four characters that lie inside one document: (document, bucket) of each."""
    x, off = characters(data, off)
    x = x.astype(U)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    d, h = [], []
    three = x[:-2] | x[1:-1] << U(21) | x[2:] << U(42)  # exact; a fourth character is mixed in
    four = mix(three[:-1] + U(4)) ^ x[3:] if len(x) > 3 else three[:0]
    for n, v in ((3, three), (4, four)):
        ok = doc[: len(v)] == doc[n - 1 :][: len(v)]
        d.append(doc[: len(v)][ok])
        h.append((mix(v[ok]) >> U(50)).astype(np.int64))
    return np.concatenate(d), np.concatenate(h)


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The model, a table (lang, bucket, n): counts by language; bucket BUCKETS has the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            data, off = byte_view(b.column(1))
            codes = {k: i for i, k in enumerate(sorted(set(names)))}
            code = np.array([codes[n] for n in names], np.int64)
            for k in codes:
                docs[k] = docs.get(k, 0) + names.count(k)
                total.setdefault(k, np.zeros(BUCKETS, np.int64))
            for lo, hi in blocks(off):
                d, h = grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                got = np.bincount(code[lo:hi][d] * BUCKETS + h, minlength=len(codes) * BUCKETS).reshape(-1, BUCKETS)
                for k, i in codes.items():
                    total[k] += got[i]
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(at) + 1), pa.string()), pa.array([*at.tolist(), BUCKETS], pa.int32()), pa.array([*v[at].tolist(), docs[k]], pa.int64())], ["lang", "bucket", "n"])

    seen = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return materialize(seen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")


def matrix(model: DataFrame, names: list[str], total: int) -> np.ndarray:
    """(buckets + 1, languages) log-probabilities of the given languages, priors last."""
    got = model.where(F.col("lang").isin(names)).toArrow()
    m = np.zeros((BUCKETS + 1, len(names)))
    code = pc.index_in(got["lang"].combine_chunks(), pa.array(names)).to_numpy(zero_copy_only=False)
    m[got["bucket"].to_numpy(), code] = got["n"].to_numpy()
    m[:BUCKETS] += 0.5
    m[:BUCKETS] = np.log(m[:BUCKETS] / m[:BUCKETS].sum(0))
    m[BUCKETS] = np.log(m[BUCKETS] / total)
    return m


def predict(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, lang_pred, score. Uses the text alone."""
    priors = model.where(F.col("bucket") == BUCKETS)
    names = sorted(r["lang"] for r in priors.select("lang").collect())  # a name per language
    total = priors.agg(F.sum("n")).first()[0]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, held_out boolean, lang_pred string, top double, total double"
    state = docs.select("doc_id", "text", "held_out", F.lit("und").alias("lang_pred"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("total"))

    def part(some: list[str], shared) -> "callable":
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                data, off = byte_view(b.column(1))
                n = b.num_rows
                best, top, mass = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                for lo, hi in blocks(off):
                    d, h = grams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    cells, times = np.unique(d * BUCKETS + h, return_counts=True)
                    doc = cells // BUCKETS
                    s = np.stack([np.bincount(doc, times * m[cells % BUCKETS, k], hi - lo) for k in range(len(some))], 1) + m[BUCKETS]
                    best[lo:hi], top[lo:hi] = s.argmax(1), s.max(1)
                    mass[lo:hi] = np.exp(s - s.max(1, keepdims=True)).sum(1)
                old = b.column(4).to_numpy(zero_copy_only=False)
                old = np.where(np.isnan(old), -np.inf, old)
                new = np.maximum(old, top)
                mass = mass * np.exp(top - new) + b.column(5).to_numpy() * np.exp(old - new)
                pred = [some[k] if t > o else p for k, t, o, p in zip(best, top, old, b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pred, pa.string()), pa.array(new), pa.array(mass)], names=b.schema.names)

        return rows

    for lo in range(0, len(names), LANGS):
        some = names[lo : lo + LANGS]
        state = state.mapInArrow(part(some, docs.sparkSession.sparkContext.broadcast(matrix(model, some, total))), schema)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(names))
    return state.select("doc_id", "held_out", F.when(letters, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(letters, 1 / F.col("total")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs (doc_id, text, lang) that aren't held out; predict every row."""
    fold = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"))
    return predict(fold, train(fold.where("not held_out")))
