"""Operator 7: MinHash near-duplicate removal by fast similarity sketching.

Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct
k-word shingles (with fewer words, the whole sequence), as 64-bit hashes. Documents with equal sets
are one class. Each class is sketched, and its coordinates are cut into bands such that a pair at
the threshold is missed with probability under 1e-8. Classes that share a band are joined into
clusters (star edges, so a bucket of m gives m - 1 edges), and links are confirmed on full sets
inside each cluster: a breadth-first search from each unreached set, comparing a set only with those
not yet reached, which finds exactly the components without listing pairs. A cluster that is larger
than CLUSTER_BYTES is cut into blocks; a task then compares two blocks and emits only the links of a
spanning forest, so no task holds more than two blocks.

Null or empty texts and texts without words have an empty set, link with nothing and are kept.
component_id is the least doc_id of the linked documents. doc_id names a document: repeated rows
are rows of the result each, and rows of one doc_id with different texts count as linked. A row
without doc_id is never compared; it belongs to the class of equal sets, if others have one, else
its component_id is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, U, blocks, byte_view, distinct, i64, materialize, mix, shingles, words
from .components import components
from .sketch import bands, sketch

CLUSTER_BYTES = 24 << 20
MISS = 1e-8


def plan(threshold: float, rows: int = 5) -> tuple[int, int]:
    """Number of bands of `rows` coordinates that miss a pair at the threshold with probability under MISS."""
    return int(np.ceil(log(MISS) / log(1 - threshold**rows))), rows


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = byte_view(column)
    for lo, hi in blocks(off):
        w, woff = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, *distinct(*shingles(w, woff, k))


def signatures(docs: DataFrame, k: int, threshold: float, text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, s1, s2 (the set's 128-bit key), bands array<long>."""
    n_bands, rows = plan(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, off in _sets(b.column(1), k):
                key = bands(sketch(h, off, n_bands * rows), rows)
                key[np.diff(off) == 0] = 0
                size = np.diff(off)
                keys = []
                for salt in (1, 2):  # sums of mixed elements: equal sets have equal keys
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ mix(np.array([salt], U))[0]))])
                    keys.append(mix(total[off[1:]] - total[off[:-1]] + size.astype(U)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * n_bands, n_bands, dtype=np.int32)), i64(key.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), i64(size), i64(keys[0]), i64(keys[1]), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _links(sets: list[np.ndarray], num: int, den: int, left: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with left, only pairs across sets[:left] and the rest
    are compared. Sets A and B link if den * |A & B| >= num * |A | B|."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    out: list[tuple[int, int]] = []
    flat = np.concatenate(sets)
    off = np.concatenate([[0], np.cumsum(size)])

    def linked(i: int, among: np.ndarray) -> np.ndarray:
        """Which of `among` link with i, by exact intersections."""
        a = size[i]
        among = among[(size[among] * den >= a * num) & (a * den >= size[among] * num)]
        if not len(among):
            return among
        at = np.repeat(off[among] - np.concatenate([[0], np.cumsum(size[among])[:-1]]), size[among]) + np.arange(size[among].sum())
        x = flat[at]
        p = np.searchsorted(sets[i], x)
        p[p == a] = 0
        common = np.add.reduceat((sets[i][p] == x).astype(np.int64), np.concatenate([[0], np.cumsum(size[among])[:-1]]))
        return among[den * common >= num * (a + size[among] - common)]

    if not left:
        free = np.ones(n, bool)
        for seed in order[::-1]:
            if not free[seed]:
                continue
            free[seed] = False
            todo = [seed]
            while todo:
                i = todo.pop()
                for j in linked(i, np.flatnonzero(free)):
                    free[j] = False
                    out.append((i, j))
                    todo.append(j)
        return out
    # across two blocks: only pairs that aren't yet connected matter, so keep a forest over both
    root = np.arange(n)
    for i in range(left):
        rest = np.arange(left, n)
        for j in linked(i, rest[root[rest] != root[i]]):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs (doc_id long, text) -> doc_id, n_shingles, component_id, kept; links at percent / 100."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = materialize(signatures(docs, k, percent / 100), "signatures")
    # a class goes by its least doc_id
    classes = materialize(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("m"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")),
        "classes",
    )
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    # star edges to the least node of each bucket; a bucket is aggregated, never held
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("key", "hub")
    stars = keyed.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = materialize(components(stars).withColumnRenamed("root", "cluster"), "clusters")

    size = clusters.join(classes.select("node", "size"), "node")
    parts = size.groupBy("cluster").agg(F.ceil(F.sum(F.col("size") * 8 + 64) / F.lit(CLUSTER_BYTES)).cast("int").alias("parts"))
    placed = clusters.join(parts, "cluster").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int"))
    members = Bloom.build(clusters, "node").keep(docs.where("doc_id is not null"), "doc_id")
    texts = placed.join(members, placed.node == members.doc_id)
    # block x of a cluster takes part in the tasks (x, y) and (y, x) for every block y of it
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tasks = texts.withColumn("other", other).select("node", "cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, off in _sets(b.column(5), k):
                part = b.slice(lo, hi - lo)
                raw = pa.array([h[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], raw], ["node", "cluster", "x", "y", "block", "set"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            """The task's links; held has each distinct set of a node once, however often its rows are repeated."""
            keys = sorted(held, key=lambda n: held[n])
            left = 0 if now[1] == now[2] else sum(held[n] == now[1] for n in keys)
            whole = now[1] == now[2] or 0 < left < len(keys)
            found = _links([np.frombuffer(raw, U) for _, raw in keys], percent, 100, left) if whole and len(keys) > 1 else []
            nodes = [n for n, _ in keys]
            found = [(i, j) for i, j in found if nodes[i] != nodes[j]]
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            node, cluster, x, y, block, sets = b.columns
            for i in range(b.num_rows):
                task = (cluster[i].as_py(), x[i].as_py(), y[i].as_py())
                if task != now:
                    if held:
                        yield out()
                    now, held = task, {}
                if raw := sets[i].as_py():
                    held[node[i].as_py(), raw] = block[i].as_py()
        if held:
            yield out()

    ready = tasks.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(to_sets, "node long, cluster long, x int, y int, block int, set binary")
    links = ready.mapInArrow(confirm, "a long, b long")
    # the classes that rows of one doc_id belong to are linked
    real = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "s1", "s2")
    many = real.groupBy("doc_id").agg(*(f("s" + i).alias(f.__name__ + i) for i in "12" for f in (F.min, F.max))).where("min1 <> max1 or min2 <> max2").select("doc_id")
    same = real.join(many, "doc_id").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(same))
    several = classes.where("m > 1").select("s1", "s2", "node")
    named = sig.select("doc_id", "n_shingles", "s1", "s2").join(several, ["s1", "s2"], "left")
    node = F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id"))
    out = named.select("doc_id", "n_shingles", node.alias("node")).join(roots, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
