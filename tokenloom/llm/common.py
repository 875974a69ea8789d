"""Shared pieces: working tables, text keys, Bloom filters, vectorised text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Largest Bloom filter, in bits. A filter that is too small passes more rows; results stay whole.
BLOOM_BITS = 1 << 28


#: Rows of an Arrow batch and bytes of text that are worked on at once; they bound a Python worker's memory.
BATCH_ROWS, BLOCK_BYTES = 1024, 1 << 18


def bounded(spark: SparkSession) -> None:
    """See that Arrow batches of documents stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    bounded(df.sparkSession)
    return storage.materialize(df, name)


def text_keys(text: str | Column = "text") -> list[Column]:
    """A 128-bit key of a text, as two BIGINT columns h1 and h2; null counts as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U(30))
    h *= _M2
    h ^= h >> U(27)
    h *= _M3
    h ^= h >> U(31)
    return h


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        p = 0xD6E8FEB86659FD93
        for key, base in (("p", p), ("i", pow(p, -1, 1 << 64))):
            a = np.full(size, base, U)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["i"][:n]


_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Signs of ASCII as spaces, so that words are runs of letters and digits (and of other characters).
SIGNS_OFF = np.arange(256, dtype=np.uint8)
SIGNS_OFF[[b for b in range(128) if not chr(b).isalnum()]] = 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_INSIDE = (~_SPACE).view(np.uint8)


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1 + arr.offset)[arr.offset :] if len(arr) else np.zeros(1, np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together (one long document is a range of its own)."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) and n + 1 offsets by document.
    A-Z count as a-z."""
    return placed_words(data, off)[:2]


def placed_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with the bytes at which each word starts and ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(len(off), np.int64), none, none
    inside = mapped(data, _INSIDE).view(bool)
    data = mapped(data, _LOWER)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:n]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    s = np.flatnonzero(inside & ~before)
    e = np.flatnonzero(inside & ~after) + 1
    p, inv = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * p, out=total[1:])
    h = mix((total[e] - total[s]) * inv[s] + (e - s).astype(U) * _M1)
    return h, np.searchsorted(s, off).astype(np.int64), s, e


def shingles(w: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document and offsets; with fewer words the whole
    sequence is one shingle, without words there is none. Not made distinct."""
    count = np.diff(off)
    m = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(m)])
    h = np.empty(int(out[-1]), U)
    c = [mix(np.array([i + 1], U) * _M1)[0] | U(1) for i in range(k)]
    if len(w) >= k:
        full = np.zeros(len(w) - k + 1, U)
        for i in range(k):
            full += w[i : len(w) - k + 1 + i] * c[i]
        full = mix(full + U(k))
        long = np.flatnonzero(count >= k)
        take = np.repeat(off[long] - out[long], m[long]) + _ranges(out[long], m[long])
        h[_ranges(out[long], m[long])] = full[take]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            v = np.zeros(len(short), U)
            for i in range(n):
                v += w[off[short] + i] * c[i]
            h[out[short]] = mix(v + U(n))
    return h, out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    return np.arange(total) - np.repeat(first, length) + np.repeat(start, length)


ranges = _ranges


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document."""
    parts = [np.unique(h[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
    out = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), out


def i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64, copy=False))


class Bloom:
    """A Bloom filter of BIGINT keys, of bounded size; build() counts its keys first."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = U(len(bits) * 64 - 1)

    @staticmethod
    def _positions(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
        h = mix(keys.view(U) ^ _M1)
        return [h & mask, (h >> U(32)) & mask, mix(h) & mask]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for p in self._positions(keys, self.mask):
            hit &= (self.bits[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1
        return hit

    @classmethod
    def build(cls, df: DataFrame, column: str) -> "Bloom":
        """From the non-null values of a column. What reaches the driver is at most BLOOM_BITS bits."""
        df = df.select(F.col(column).alias("k")).where("k is not null")
        n = df.count()
        size = max(1 << 16, min(BLOOM_BITS, 1 << max(1, (16 * n - 1).bit_length())))
        mask = U(size - 1)

        def rows(batches):
            bits = np.zeros(size // 64, U)
            for b in batches:
                k = b.column(0).to_numpy(zero_copy_only=False)
                for p in cls._positions(k, mask):
                    np.bitwise_or.at(bits, (p >> U(6)).astype(np.int64), U(1) << (p & U(63)))
            at = np.flatnonzero(bits)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), i64(bits[at])], ["i", "v"])

        got = df.mapInArrow(rows, "i long, v long").groupBy("i").agg(F.bit_or("v").alias("v")).toArrow()
        bits = np.zeros(size // 64, U)
        bits[got["i"].to_numpy()] = got["v"].to_numpy().view(U)
        return cls(bits)

    def keep(self, df: DataFrame, column: str, negate: bool = False) -> DataFrame:
        """Rows whose key may be (or surely isn't) in the filter."""
        shared = df.sparkSession.sparkContext.broadcast(self.bits)

        def rows(batches):
            f = Bloom(shared.value)
            for b in batches:
                hit = f.contains(b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False))
                yield b.filter(pa.array(hit ^ negate))

        return df.mapInArrow(rows, df.schema)
