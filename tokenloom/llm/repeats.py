"""Operator 2: exact repeated substrings, by suffix arrays over shards.

A symbol (a byte, or a word) is repeated if a string of `length` symbols that covers it starts at a
second place of the corpus, in the same document or another. Each such string holds an anchor: of the
windows of `anchor` symbols inside it the one with the least hash (the first among equals), which depends on
the string alone. The strings with one anchor start side by side; they span the anchor's piece of text. So

1. anchors are counted over all texts (8 bytes of hash each, pre-aggregated), and occurrences of
   anchors that occur twice are kept, with a 128-bit hash of their piece;
2. equal pieces are one class, known by its first and last place. Both places go, as text, to the shard of the
   anchor, together with the other classes of the anchor. So what is equal is settled there, not by hashes:
   whole pieces are compared, and where they are equal all of their strings are repeated;
3. in a shard the anchor, which is the same in all of its pieces (its bytes are compared), is one symbol.
   The suffix array is built by induced sorting; where the permuted common prefixes reach a string's length,
   neighbouring suffixes are one string, and strings of two places mark their symbols;
4. what is marked in a class holds for all of its places.

The pieces of an anchor share a shard. An anchor that would be too many for one (a passage inside many
different texts) is split by the symbols that come next: its strings that go on far to the right get a
longer anchor that reaches to the right, the others one that reaches to the left, and so on (see _longer);
at the last step an anchor is a whole string and all its pieces are equal. Every step treats all strings.

Documents are known by 128-bit keys of their texts, so copies are handled once (all of a text that is
there twice is repeated), and repeated rows, missing or repeated doc_ids need no care. Bloom filters of
bounded size keep rows that can't match out of shuffles; they drop nothing else.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased, known by 64-bit hashes.
Null and empty texts have no symbols; texts shorter than `length` are never touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, SIGNS_OFF, Bloom, U, _M1, _M2, _M3, blocks, byte_view, i64, mapped, materialize, mix, placed_words, text_keys
from .sais import common_prefixes, suffix_array, wide_suffix_array

#: Symbols of a shard, and pieces of one anchor that a shard takes; more are split by what comes next.
SHARD_SYMBOLS, MANY = 1 << 19, 2000
_MUL = [_M1, _M2, _M3, U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


@dataclass(frozen=True)
class Grain:
    """What strings are made of, how long they are, and the length of their anchors (a power of two)."""

    unit: str
    length: int
    anchor: int

    def __post_init__(self) -> None:
        if not self.anchor < self.length <= 2 * self.anchor:
            raise ValueError("length must be over anchor and at most twice as much")

    @property
    def width(self) -> int:
        """Bytes of a symbol."""
        return 1 if self.unit == "bytes" else 8

    @property
    def block(self) -> int:
        """Bytes of text that anchors are looked for at once: their hashes then stay in a core's cache."""
        return 1 << 15 if self.unit == "bytes" else 1 << 17

    def symbols(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the symbols, and n + 1 offsets by document."""
        return (_BYTE[data], off) if self.unit == "bytes" else placed_words(mapped(data, SIGNS_OFF), off)[:2]

    def raw(self, text: bytes) -> bytes:
        """A text as symbols of `width` bytes."""
        if self.unit == "bytes":
            return text
        data = np.frombuffer(text, np.uint8)
        return placed_words(SIGNS_OFF[data], np.array([0, len(data)]))[0].tobytes()


BYTES = Grain("bytes", 400, 256)
PASSAGE = Grain("words", 50, 32)


def _doubling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of size symbols, a power of two."""
    spare = np.empty((2, len(h)), U)
    for k in range(size.bit_length() - 1):
        out = spare[k & 1, : max(0, len(h) - (1 << k))]
        np.multiply(h[: len(out)], _MUL[k], out=out)
        out += h[len(h) - len(out) :]
        h = out
    return h


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i + w] for every i, of windows of doubling size."""
    spare, n, size = np.empty((2, len(x)), x.dtype), len(x) - w + 1, 1
    for k in range(w.bit_length() - 1):
        x = np.minimum(x[:-size], x[size:], out=spare[k & 1, : len(x) - size])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def anchors(h: np.ndarray, off: np.ndarray, grain: Grain) -> tuple[np.ndarray, ...]:
    """Anchors of a block of documents: (document, first start, last start, anchor's place, anchor's
    hash, piece's hash). The strings of one anchor start from first to last."""
    length, anchor = grain.length, grain.anchor
    size = np.diff(off)
    doc = np.flatnonzero(size >= length)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U), np.zeros(0, U)
    g = _doubling(h, anchor)
    # hash above, place below: the least is the first of the least; 32 bits decide alike everywhere
    order = g & U(0xFFFFFFFF00000000)
    order |= np.arange(len(g), dtype=U)
    least = _sliding_least(order, length - anchor + 1)
    begin = off[doc]
    stop = begin + size[doc] - length + 1
    cut = np.sort(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begin, stop]))
    cut = cut[np.concatenate([[True], cut[1:] != cut[:-1]])]
    which = np.searchsorted(begin, cut, "right") - 1
    run = np.flatnonzero((which >= 0) & (cut < stop[which]))
    first, last, which = cut[run], cut[run + 1] - 1, doc[which[run]]
    at = (least[first] & U(0xFFFFFFFF)).astype(np.int64)
    end = last + length
    piece = mix(g[first] * _M1 + mix(g[end - anchor] * _M2 + mix(g[(first + end - anchor) // 2] + (end - first).astype(U) * _M3)) + (at - first).astype(U))
    base = off[which]
    return which, first - base, last - base, at - base, mix(g[at] ^ _M1), piece


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(*text_keys(text), F.coalesce(F.col(text), F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame, grain: Grain = BYTES, text: str = "text") -> DataFrame:
    """docs (text) -> h1, h2 (the text's key), spans array<struct<a, b>>: its repeated symbols, in runs that may overlap."""
    source = _texts(docs, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = byte_view(b.column(0))
            parts = [anchors(*grain.symbols(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), grain)[4] for lo, hi in blocks(off, grain.block)]
            h, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([i64(h), i64(n)], ["anchor", "n"])

    counted = source.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    twice = materialize(counted.where("n > 1").select("anchor"), "anchors")
    may = docs.sparkSession.sparkContext.broadcast(Bloom.build(twice, "anchor").bits)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(may.value)
        for b in batches:
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, off = byte_view(b.column(2))
            for lo, hi in blocks(off, grain.block):
                d, first, last, at, a, c = anchors(*grain.symbols(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), grain)
                hit = bloom.contains(a)
                d = d[hit] + lo
                short = [pa.array(x[hit].astype(np.int32)) for x in (first, last, at)]
                yield pa.RecordBatch.from_arrays([i64(a[hit]), i64(c[hit]), i64(h1[d]), i64(h2[d]), *short], ["anchor", "piece", "h1", "h2", "first", "last", "at"])

    found = source.mapInArrow(occurrences, "anchor long, piece long, h1 long, h2 long, first int, last int, at int")
    found = materialize(found.groupBy("anchor", "piece", "h1", "h2", "first", "last", "at").agg(F.count("*").alias("n")), "occurrences")
    place = F.struct("h1", "h2", "first", "last", "at")
    classes = materialize(_chosen(found.groupBy("anchor", "piece").agg(F.count("*").alias("m"), F.min(place).alias("one"), F.max(place).alias("two"))), "classes")
    runs = _runs(materialize(_cut(source, classes, grain), "pieces"), grain)
    long = lambda c: F.col(c).cast("long")
    marked = found.join(runs, ["anchor", "piece"]).select("h1", "h2", (long("first") + F.col("a")).alias("a"), (long("first") + F.col("b")).alias("b"))
    copied = found.where("n > 1").select("h1", "h2", long("first").alias("a"), (long("last") + grain.length).alias("b"))
    return materialize(marked.unionByName(copied).groupBy("h1", "h2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def _chosen(classes: DataFrame, last: bool = False) -> DataFrame:
    """The classes (anchor, piece, m, one, two) of anchors that have two places, with many: does the
    anchor have more than MANY classes? At the last step it has one."""
    per = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.max("m").alias("most")).where("k > 1 or most > 1")
    return classes.join(per, "anchor").select("anchor", "piece", "one", "two", (F.lit(not last) & (F.col("k") > MANY)).alias("many"))


def _cut(source: DataFrame, classes: DataFrame, grain: Grain) -> DataFrame:
    """The text of the first and the last place of each class: anchor, piece, many, h1, h2, a, left, raw."""
    places = classes.select("anchor", "piece", "many", F.explode(F.array_distinct(F.array("one", "two"))).alias("x")).select("anchor", "piece", "many", "x.*")
    may = source.sparkSession.sparkContext.broadcast(Bloom.build(places, "h1").bits)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text that is there many times is sent once per task."""
        bloom, seen = Bloom(may.value), set()
        for b in batches:
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            keep = bloom.contains(h1)
            for i in np.flatnonzero(keep):
                key = (h1[i], h2[i])
                keep[i] = key not in seen
                seen.add(key)
            yield b.filter(pa.array(keep))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, w = None, grain.width
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i in range(b.num_rows):
                h1, h2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if (h1, h2) == last:
                    continue
                last = h1, h2
                raw = grain.raw(b.column(2)[i].as_py().encode())
                for x in b.column(3)[i].as_py():
                    a = x["first"]
                    for column, v in zip(out, (x["anchor"], x["piece"], x["many"], h1, h2, a, x["at"] - a, raw[a * w : (x["last"] + grain.length) * w])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PIECE.types)], names=_PIECE.names)

    need = places.groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "piece", "many", "first", "last", "at")).alias("places"))
    texts = source.mapInArrow(once, source.schema).join(need, ["h1", "h2"])
    return texts.select("h1", "h2", "text", "places").mapInArrow(cut, "anchor long, piece long, many boolean, h1 long, h2 long, a long, left long, raw binary")


_PIECE = pa.schema([("anchor", pa.int64()), ("piece", pa.int64()), ("many", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int64()), ("left", pa.int64()), ("raw", pa.binary())])


def _runs(pieces: DataFrame, grain: Grain) -> DataFrame:
    """What is repeated in each class (anchor, piece) of pieces: runs a, b from the piece's start."""
    spark = pieces.sparkSession
    total, many = pieces.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)), F.coalesce(F.bool_or("many"), F.lit(False))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= SHARD_SYMBOLS and row[0] != last:  # all pieces of an anchor share a shard
                    yield _shard(held, grain)
                    held, size = [], 0
                held.append(row)
                size += len(row[6]) // grain.width - grain.anchor + 2
                last = row[0]
        if held:
            yield _shard(held, grain)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * SHARD_SYMBOLS * grain.width)))
    few = pieces.where("not many").drop("many").repartition(parts, "anchor").sortWithinPartitions("anchor")
    runs = few.mapInArrow(shards, "anchor long, piece long, a long, b long")
    if not many:
        return runs
    longer = replace(grain, anchor=grain.anchor + (grain.length - grain.anchor + 1) // 2) if grain.anchor < grain.length - 1 else _Whole(grain.unit, grain.length, grain.length)
    schema = "anchor long, piece long, h1 long, h2 long, a long, left long, raw binary, up_anchor long, up_piece long, shift long"
    parts_of = materialize(pieces.where("many").mapInArrow(lambda x: _longer(x, grain, longer.anchor), schema), "longer")
    place = F.struct("h1", "h2", "a", "left", "raw")
    classes = parts_of.groupBy("anchor", "piece").agg(F.count_distinct("h1", "h2", "a").alias("m"), F.min(place).alias("one"), F.max(place).alias("two"))
    chosen = _chosen(classes, longer.anchor == grain.length).select("anchor", "piece", "many", F.explode(F.array_distinct(F.array("one", "two"))).alias("x")).select("anchor", "piece", "many", "x.*")
    below = _runs(materialize(chosen, "pieces"), longer)
    up = parts_of.select("anchor", "piece", "up_anchor", "up_piece", "shift").distinct()
    lifted = below.join(up, ["anchor", "piece"]).select(F.col("up_anchor").alias("anchor"), F.col("up_piece").alias("piece"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))
    return runs.unionByName(lifted)


class _Whole(Grain):
    """The last step: an anchor is a whole string."""

    def __post_init__(self) -> None:
        pass


def _longer(batches: Iterator[pa.RecordBatch], grain: Grain, anchor: int) -> Iterator[pa.RecordBatch]:
    """Pieces cut in two with longer anchors: strings that start near the anchor go on to its right, the
    others begin to its left. Every string of the piece is in one of the two."""
    w, more = grain.width, anchor - grain.anchor
    digest = lambda x, n: int.from_bytes(hashlib.blake2b(x, digest_size=n).digest(), "little", signed=True)
    names = ["anchor", "piece", "h1", "h2", "a", "left", "raw", "up_anchor", "up_piece", "shift"]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for up_anchor, up_piece, _, h1, h2, a, left, raw in zip(*(c.to_pylist() for c in b.columns)):
            last = len(raw) // w - grain.length  # starts are 0 .. last, the anchor's is left
            right = (max(0, left + anchor - grain.length), min(last, left), left)
            before = (max(0, left + grain.anchor - grain.length), min(last, left - more), left - more)
            for lo, hi, at in (right, before):
                if lo > hi:
                    continue
                part = raw[lo * w : (hi + grain.length) * w]
                key = raw[at * w : (at + anchor) * w]
                row = (digest(key, 8), digest(part + bytes([at - lo & 255, at - lo >> 8]), 8), h1, h2, a + lo, at - lo, part, up_anchor, up_piece, lo)
                for column, v in zip(out, row):
                    column.append(v)
        types = [pa.int64()] * 6 + [pa.binary()] + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)


def _shard(held: list[tuple], grain: Grain) -> pa.RecordBatch:
    """Runs of the strings that start at two places, of pieces (anchor, piece, h1, h2, a, left, raw)."""
    first_of: dict[tuple, list] = {}  # equal pieces are sorted once
    twice, anchor_of = set(), {}
    for x in held:
        y = first_of.setdefault(x[:2] + x[5:], x)
        if y is not x and y[2:5] != x[2:5]:
            twice.add(x[:2])
    held = list(first_of.values())
    for x in held:
        anchor_of[x[0]] = anchor_of.get(x[0], 0) + 1
    whole = [(*x[:2], 0, len(x[6]) // grain.width) for x in held if x[:2] in twice]
    held = [x for x in held if anchor_of[x[0]] > 1]  # the others share their anchor with equal pieces alone
    columns = [np.array([w[i] for w in whole], np.int64) for i in range(4)]
    if held:
        columns = [np.concatenate(c) for c in zip(columns, _sorted_runs(held, grain))]
    return pa.RecordBatch.from_arrays([i64(c) for c in columns], ["anchor", "piece", "a", "b"])


def _sorted_runs(held: list[tuple], grain: Grain) -> list[np.ndarray]:
    """Anchor, piece, start and end of the runs that a suffix array over the pieces finds."""
    need = grain.length - grain.anchor + 1  # a string's length, with its anchor as one symbol
    w, width = grain.width, grain.anchor * grain.width
    same: dict[bytes, int] = {}
    documents: dict[tuple[int, int], int] = {}
    anchor = np.array([same.setdefault(x[6][x[5] * w : x[5] * w + width], len(same)) for x in held])
    size = np.array([len(x[6]) // w - grain.anchor + 2 for x in held])  # the anchor, and an end, are a symbol each
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    first, left = np.array([x[4] for x in held]), np.array([x[5] for x in held])
    rest = np.frombuffer(b"".join([part for x in held for part in (x[6][: x[5] * w], x[6][x[5] * w + width :])]), np.uint8 if w == 1 else U)
    letters = 256
    if w > 1:
        values, rest = np.unique(rest, return_inverse=True)
        letters = len(values) + 1
    t = np.empty(int(size.sum()), np.int32)
    plain = np.ones(len(t), bool)
    plain[begin + left] = plain[begin + size - 1] = False
    t[plain] = rest
    t[begin + left] = letters + anchor
    t[begin + size - 1] = letters - 1  # no UTF-8 holds 255
    sa = suffix_array(t, letters + len(same)) if w == 1 else wide_suffix_array(t, letters + len(same))
    prefix = common_prefixes(t, sa, int(size.max()), begin)
    doc = np.array([documents.setdefault(x[2:4], len(documents)) for x in held])
    piece = np.repeat(np.arange(len(held)), size)
    inside = np.arange(len(t)) - begin[piece]
    place = (doc[piece] << 32) | (first[piece] + inside)
    fits = inside + need < size[piece]
    ordered = sa[fits[sa]]
    new = prefix[ordered] < need
    new[:1] = True
    run = np.flatnonzero(new)
    p = place[ordered]
    several = np.minimum.reduceat(p, run) != np.maximum.reduceat(p, run) if len(run) else np.zeros(0, bool)
    at = np.sort(ordered[np.repeat(several, np.diff(np.append(run, len(ordered))))])
    keys, once, told = [], np.zeros(len(held), bool), set()
    for i, x in enumerate(held):  # both places of a class say the same
        keys.append(x[:2])
        once[i] = x[:2] not in told
        told.add(x[:2])
    at = at[once[piece[at]]]
    if len(at):
        cut = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])  # within a piece all strings overlap
        lo, hi = at[cut], at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)]
    else:
        lo = hi = at
    k = np.array(keys, np.int64).reshape(-1, 2)[piece[lo]]
    return [k[:, 0], k[:, 1], inside[lo], inside[hi] + grain.length]


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Disjoint, ordered runs inside 0..size."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["a"]), min(size, s["b"])) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_bytes(raw: bytes, spans: list[dict] | None, grain: Grain) -> list[tuple[int, int]]:
    """Disjoint runs of repeated bytes of a text, of its spans of symbols; a run of words is from the
    first one's start to the last one's end."""
    if not spans:
        return []
    if grain.unit == "bytes":
        return merged(spans, len(raw))
    _, _, start, end = placed_words(SIGNS_OFF[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
    return [(int(start[a]), int(end[b - 1])) for a, b in merged(spans, len(start))]


def runs_in_bytes(spans: pa.ListArray, data: np.ndarray, off: np.ndarray, grain: Grain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """in_bytes() of all texts (data, off) of a batch: each run's text, start and end in it, in order."""
    doc = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    a, b = (np.maximum(flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64), 0) for x in ("a", "b"))
    if not len(doc):
        return doc, a, b
    count = np.diff(off)
    if grain.unit != "bytes":
        places = [np.zeros(0, np.int64)] * len(spans)
        for lo, hi in blocks(off, grain.block):
            if np.searchsorted(doc, lo) < np.searchsorted(doc, hi):
                _, at, start, end = placed_words(mapped(data[off[lo] : off[hi]], SIGNS_OFF), off[lo : hi + 1] - off[lo])
                both = np.stack([start, end]) + off[lo]
                places[lo:hi] = [both[:, x:y] for x, y in zip(at[:-1], at[1:])]
        count = np.array([x.shape[-1] for x in places])
    b = np.minimum(b, count[doc])
    wide = int(off[-1]) + 2  # texts are apart in one order
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order] + doc[order] * wide, b[order] + doc[order] * wide
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    last = np.append(first[1:], len(a)) - 1
    doc, a, b = doc[first], a[first] - doc[first] * wide, reach[last] - doc[first] * wide
    if grain.unit != "bytes":
        a, b = (np.array([places[d][x, y] for d, y in zip(doc, at)], np.int64) - off[doc] for x, at in ((0, a), (1, b - 1)))
    return doc, a, b


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def with_spans(docs: DataFrame, spans: list[DataFrame], text: str = "text", others: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """docs as (row struct, h1, h2), in two parts: rows whose text has spans (with them: spans0, ...), and the
    others. The others, most of a corpus, aren't shuffled; their row is the struct `others`, if it is given, and then their
    texts stay out of Python. Columns of docs can't clash, as they are in row."""
    keyed = docs.select(F.struct("*").alias("row"), *text_keys(text))
    both = None
    for i, s in enumerate(spans):
        s = s.withColumnRenamed("spans", f"spans{i}")
        both = s if both is None else both.join(s, ["h1", "h2"], "full")
    may = Bloom.build(both, "h1")
    hit = may.keep(keyed, "h1").join(both, ["h1", "h2"], "left")
    return hit, may.keep(keyed if others is None else docs.select(others.alias("row"), *text_keys(text)), "h1", negate=True)


def remove_repeats(docs: DataFrame, grain: Grain = BYTES, passage: Grain = PASSAGE, text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 by grain; passage_bytes and
    n_passages: the bytes and maximal runs of words that are in passages which occur elsewhere too."""
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    hit, rest = with_spans(docs, [repeated_spans(docs, grain), repeated_spans(docs, passage)], others=short)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "n_passages"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = byte_view(b.column(1))
            cut, told = runs_in_bytes(b.column(2), data, off, grain), runs_in_bytes(b.column(3), data, off, passage)
            n = [np.bincount(d, minlength=b.num_rows) for d, _, _ in (cut, told)]
            size = [np.bincount(d, y - x, b.num_rows) for d, x, y in (cut, told)]
            kept, starts, ends, edge = [], (off[cut[0]] + cut[1]).tolist(), (off[cut[0]] + cut[2]).tolist(), np.concatenate([[0], np.cumsum(n[0])]).tolist()
            view = memoryview(data)
            for k, (at, end) in enumerate(zip(off.tolist(), off[1:].tolist())):
                digest = hashlib.sha256()
                for r in range(edge[k], edge[k + 1]):
                    digest.update(view[at : starts[r]])
                    at = ends[r]
                digest.update(view[at:end])
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), i64(np.diff(off)), i64(size[0]), i64(n[0]), pa.array(kept, pa.string()), i64(size[1]), i64(n[1])], names)

    changed = hit.select("row.doc_id", "row.text", "spans0", "spans1").mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_bytes long, n_passages long")
    zero = F.lit(0).cast("long")
    same = rest.select("row.doc_id", "row.n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "row.kept_sha256", zero.alias("passage_bytes"), zero.alias("n_passages"))
    return changed.unionByName(same)


def cut_repeats(docs: DataFrame, grain: Grain = PASSAGE, text: str = "text") -> DataFrame:
    """docs with what is repeated cut out of the text, wherever it occurs; of characters only whole ones.
    Other columns stay; null stays null."""
    columns = docs.columns
    hit, rest = with_spans(docs, [repeated_spans(docs, grain, text)], text)
    at = columns.index(text)
    schema = docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, new = b.column(0).flatten(), []
            for t, s in zip(cols[at].to_pylist(), b.column(1).to_pylist()):
                if t is not None and s:
                    raw = t.encode()
                    runs = []
                    for x, y in in_bytes(raw, s, grain):
                        while x < y and raw[x] & 0xC0 == 0x80:
                            x += 1
                        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                            y -= 1
                        runs.append((x, y))
                    t = without(raw, runs).decode()
                new.append(t)
            cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, columns)

    return hit.select("row", "spans0").mapInArrow(rows, schema).unionByName(rest.select("row.*"))
