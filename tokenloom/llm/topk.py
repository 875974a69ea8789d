"""Operator 4: exact top-k inner-product search with a ball tree per shard.

Vectors are split into shards by a hash of the row; a shard's ball tree (median splits along the direction of a far
pair; every node has a centre and a radius) is built once, by the task that owns the shard. A task owns a
lane of up to LANE shards, and each block of queries is sent to every lane (a stated query set against all
rows, in blocks). A block goes through the lane's trees and keeps its k best scores, so each tree starts
from the k-th score reached so far. In a tree every query descends first into the child with its greater
upper bound q.c + |q| r, and a node whose bound is under the query's k-th score is left out. The best of
all lanes are merged. A shard is as many rows as fit in SHARD_VALUES components, whatever their dimension.

Components x become floor(64 x), exact integers of any size, and so are scores: products are taken in
doubles where all sums are under 2**53, else doubles with an error bound choose the candidates and Python's integers
score them. A score outside of the range of a long is given as the nearest long; its rank is by its exact value.

Vectors that are null, or hold a null or non-finite component, and rows without vec_id, take no part.
Vectors of another length than the query's are no candidates for it. Repeated rows are candidates each; a
query never meets rows of its own vec_id. Repeated query ids count once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, LEAF = 64, 256
SHARD_VALUES, BLOCK_VALUES, LANE = 1 << 20, 1 << 16, 8
_EXACT, _WILD = 2.0**53, 2.0**400
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantize(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v array<double> of floor(64 x) / 64, dim, of the rows that take part.
    Doubles from 2**53 on are integers already; dividing by 64 loses nothing and can't overflow."""
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < _EXACT, F.floor(F.lit(float(SCALE)) * c).cast("double") / SCALE).otherwise(c)
    return (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull())
        .where(good)
        .select("vec_id", F.transform(x, lambda c: whole(c.cast("double"))).alias("v"), F.size(x).alias("dim"))
    )


class Tree:
    """A shard's ball tree: rows in the order of the leaves; node i holds rows lo[i]:hi[i]; children[i] or None."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        self.lo, self.hi, self.children, centre, radius = [], [], [], [], []
        self.top = float(np.abs(x).max(initial=0))
        self.wild = self.top >= _WILD  # distances would overflow: one leaf
        todo = [(0, len(x), -1)]
        while todo:
            a, b, above = todo.pop()
            node = len(self.lo)
            if above >= 0:
                self.children[above].append(node)
            part = x[order[a:b]]
            c = part.mean(0) if not self.wild else np.zeros(x.shape[1])
            r = float(np.sqrt(np.square(part - c).sum(1).max(initial=0))) if not self.wild else np.inf
            self.lo.append(a)
            self.hi.append(b)
            centre.append(c)
            radius.append(r)
            self.children.append([])
            if b - a <= LEAF or self.wild:
                continue
            far = part[np.square(part - c).sum(1).argmax()]
            other = part[np.square(part - far).sum(1).argmax()]
            mid = (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(part @ (other - far), mid - a)]
            todo += [(mid, b, node), (a, mid, node)]
        self.centre, self.radius = np.stack(centre), np.array(radius)
        self.reach = np.sqrt(np.square(self.centre).sum(1)) + self.radius
        self.ids, self.x = ids[order], x[order]


def integers(row: np.ndarray) -> list[int]:
    """floor(64 x) of the components of a quantized vector."""
    return [int(v * SCALE) if abs(v) < _EXACT else int(v) * SCALE for v in row.tolist()]


class Best:
    """The k best (score, vec_id) of each query of a block; higher scores, then smaller ids. Scores are
    doubles as long as all are exact, else Python's integers."""

    def __init__(self, n: int, k: int):
        self.k, self.big = k, False
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.rows: list[list[tuple[int, int]]] = []  # of big ones: (-score, id), best first

    def kth(self) -> np.ndarray:
        """The k-th scores, or where scores are big something that isn't above them."""
        if not self.big:
            return self.score[:, -1]
        out = np.full(len(self.rows), -np.inf)
        for i, r in enumerate(self.rows):
            if len(r) == self.k and abs(r[-1][0]) < 1 << 1000:
                v = float(-r[-1][0])
                out[i] = v - abs(v) * 1e-12
        return out

    def widen(self) -> None:
        if not self.big:
            self.big = True
            self.rows = [[(-int(s), int(i)) for s, i in zip(a, b) if np.isfinite(s)] for a, b in zip(self.score, self.id)]

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score (len(rows), m), -inf for none, of the candidates ids (m)."""
        if self.big:
            for r, s in zip(rows, score):
                self.insert(r, [(-int(v), int(i)) for v, i in zip(s, ids) if np.isfinite(v)])
            return
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], 1)
        at = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, at, 1)
        self.id[rows] = np.take_along_axis(i, at, 1)

    def insert(self, row: int, found: list[tuple[int, int]]) -> None:
        self.rows[row] = sorted(self.rows[row] + found)[: self.k]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
        """Rows, ids, scores as longs, and for scores beyond a long a key that sorts as they do."""
        if not self.big:
            r, c = np.nonzero(np.isfinite(self.score))
            return r, self.id[r, c], self.score[r, c].astype(np.int64), [None] * len(r)
        flat = [(r, i, -s) for r, row in enumerate(self.rows) for s, i in row]
        key = [None if _LOW < s < _HIGH else sort_key(s) for _, _, s in flat]
        return np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64), np.array([min(max(x[2], _LOW), _HIGH) for x in flat], np.int64), key


def sort_key(v: int) -> bytes:
    """Bytes that sort as the integers do."""
    raw = abs(v).to_bytes((abs(v).bit_length() + 7) // 8, "big")
    key = len(raw).to_bytes(2, "big") + raw
    return b"\1" + key if v >= 0 else b"\0" + bytes(255 - b for b in key)


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, best: Best) -> None:
    dim = q.shape[1]
    top = float(np.abs(q).max(initial=0))
    wild = tree.wild or top >= _WILD
    exact = not wild and top * SCALE * tree.top * SCALE * max(dim, 1) < _EXACT
    if not exact:
        best.widen()
    norm = np.sqrt(np.square(q).sum(1)) if not wild else np.full(len(q), np.inf)
    square = float(SCALE * SCALE)
    if wild:
        bound = np.full((len(q), len(tree.lo)), np.inf)
    else:
        bound = (q @ tree.centre.T + norm[:, None] * tree.radius + 1e-9 * (1 + norm[:, None] * tree.reach)) * square

    def leaf(rows: np.ndarray, a: int, b: int) -> None:
        x, its = tree.x[a:b], tree.ids[a:b]
        own = ids[rows, None] == its
        kth = best.kth()[rows, None]
        if exact:
            score = (q[rows] * SCALE) @ (x * SCALE).T
            score[own] = -np.inf
            good = score >= kth
            hit, use = good.any(1), good.any(0)
            if hit.any():
                best.add(rows[hit], score[hit][:, use], its[use])
            return
        good = ~own
        if not wild:
            error = (np.abs(q[rows]) @ np.abs(x).T) * (dim + 2) * 2.0**-51
            good &= ((q[rows] @ x.T + error) * square) >= kth
        whole = {j: integers(x[j]) for j in np.flatnonzero(good.any(0))}
        for i in np.flatnonzero(good.any(1)):
            mine = integers(q[rows[i]])
            best.insert(rows[i], [(-sum(map(int.__mul__, mine, whole[j])), int(its[j])) for j in np.flatnonzero(good[i])])

    def visit(node: int, rows: np.ndarray) -> None:
        """rows: queries whose bound reaches their k-th score."""
        if not len(rows):
            return
        if not tree.children[node]:
            leaf(rows, tree.lo[node], tree.hi[node])
            return
        one, two = tree.children[node]
        first = bound[rows, one] >= bound[rows, two]
        parts = [(rows[first], one, two), (rows[~first], two, one)]
        if min(len(p[0]) for p in parts) < 32:  # a few queries go with the others
            parts = [(rows, one, two) if 2 * first.sum() >= len(rows) else (rows, two, one)]
        for mine, near, far in parts:
            for child in (near, far):
                visit(child, mine[bound[mine, child] >= best.kth()[mine]])

    visit(0, np.arange(len(q)))


def _pack(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of bounded size as one row each: ids and a dim-column matrix, as bytes."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        x = t["v"].combine_chunks().flatten().to_numpy()
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key)}, "ids": [ids.astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()]}, schema=pa.schema([*((k, pa.int32()) for k in keys), ("ids", pa.binary()), ("x", pa.binary())]))

    return df.groupBy(*keys).applyInArrow(one, ", ".join(f"{k} int" for k in keys) + ", ids binary, x binary")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """vectors (vec_id, embedding): for each row with vec_id divisible by every, its k best others."""
    v = materialize(quantize(vectors), "vectors")
    asks = F.col("vec_id") % every == 0
    n, n_query, dim = v.agg(F.count("*"), F.count_if(asks), F.coalesce(F.max("dim"), F.lit(1))).first()
    shard_rows, block_rows = (max(least, size // max(dim, 1)) for least, size in ((64, SHARD_VALUES), (16, BLOCK_VALUES)))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_query // block_rows))
    lanes = min(shards, max(-(-shards // LANE), int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # row numbers would need a sort; a hash gives groups of near-equal size, whatever the ids are
    of = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(parts)).cast("int")
    base = _pack(v.select("vec_id", "v", "dim", of(0, shards).alias("no")), ["dim", "no"]).withColumn("lane", F.pmod("no", F.lit(lanes)))
    query = _pack(v.where(asks).select("vec_id", "v", "dim", of(7, blocks).alias("no")), ["dim", "no"])
    every_lane = query.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = base.withColumn("kind", F.lit(0)).unionByName(every_lane.withColumn("kind", F.lit(1))).select("dim", "lane", "kind", "no", "ids", "x")
    schema = "dim int, no int, row int, query_id long, vec_id long, score long, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, forest = None, []
        for b in batches:
            for dim, lane, kind, no, ids, x in zip(*(c.to_pylist() for c in b.columns)):
                if (dim, lane) != now:
                    now, forest = (dim, lane), []
                ids = np.frombuffer(ids, "<i8")
                x = np.frombuffer(x, "<f8").reshape(len(ids), dim)
                if kind == 0:
                    forest.append(Tree(ids, x))
                    continue
                best = Best(len(ids), k)
                for tree in forest:
                    search(tree, ids, x, best)
                r, found, score, key = best.result()
                same = [pa.array(np.full(len(r), value, np.int32)) for value in (dim, no)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(r.astype(np.int32)), pa.array(ids[r]), pa.array(found), pa.array(score), pa.array(key, pa.binary())], ["dim", "no", "row", "query_id", "vec_id", "score", "key"])

    # a lane's shards come first, then its blocks of queries, one after another
    found = both.repartition(lanes, "dim", "lane").sortWithinPartitions("dim", "lane", "kind", "no").mapInArrow(run, schema)
    # a query is a row of its block, which all lanes share; so repeated ids stay apart
    w = Window.partitionBy("dim", "no", "row").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
