import hashlib

import numpy as np
from pyspark.sql import functions as F

from tokenloom import plans, storage
from tokenloom.functions import item_type
from tokenloom.operators import read, sample


def small(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows, words = [], []
    for i in range(n):
        m = int(rng.integers(1, 13))
        words.append([int(x) + 3 for x in rng.integers(0, 300, m)])
        rows.append((i, len(words[-1]) + 1, words[-1] + [1]))
    return rows


def test_shards_of_a_stream(spark):
    rows = small(spark)
    d = spark.createDataFrame(rows, "doc_id long, n_items long, tokens array<bigint>")
    placed = plans.offsets(d)
    flat = np.array([t for r in rows for t in r[2]], "<u2")
    got = {r["chunk"]: r["tokens"] for r in plans.chunks(placed, 128, "tokens").collect()}
    for k in range(-(-len(flat) // 128)):
        assert hashlib.sha256(np.array(got[k], "<u2").tobytes()).digest() == hashlib.sha256(flat[k * 128 : (k + 1) * 128].tobytes()).digest()
    cut = plans.shard_pieces(placed, 128).agg(F.sum(F.col("hi") - F.col("lo"))).first()[0]
    assert cut == len(flat)


def test_every_window(spark):
    rows = small(spark, 30, 3)
    flat = [t for r in rows for t in r[2]]
    n = len(flat)
    chunked = plans.chunks(plans.offsets(spark.createDataFrame(rows, "doc_id long, n_items long, items array<bigint>")), 16)
    want = spark.range(n + 1).select(F.col("id").alias("start"), F.explode(F.array(*map(F.lit, (0, 1, 5, 16, 17, 40))).cast("array<long>")).alias("length"))
    want = want.where(F.col("start") + F.col("length") <= n).select((F.col("start") * 100 + F.col("length")).alias("window"), "start", "length")
    for r in read.windows(want, chunked, 16).collect():
        assert r["tokens"] == flat[r["start"] : r["start"] + r["window"] % 100]


def test_slices(spark):
    chunked = spark.createDataFrame([(k, k * 8, [i * 7 for i in range(k * 8, min(50, k * 8 + 8))]) for k in range(7)], "chunk long, lo long, tokens array<bigint>")
    for a, b, s in [(None, None, 1), (3, -4, 5), (None, None, -3), (40, 2, -7), (10, 5, 1), (-5, 100, 2)]:
        got = [r["position"] for r in read.sliced(chunked, a, b, s, 50, 8).orderBy("rank").collect()]
        assert got == list(range(50))[a:b:s]


def test_item_types(spark):
    d = spark.createDataFrame([(v,) for v in (0, 1, 256, 257, 65536, 65537)], "v long")
    assert [r[0] for r in d.select(item_type(F.col("v"))).collect()] == [None, "uint8", "uint8", "uint16", "uint16", "uint32"]


def test_draws(spark):
    got = [r["start"] for r in sample.uniform_starts(spark, 20, 1000, 64, 5).orderBy("window").collect()]
    assert got == np.random.default_rng(5).integers(0, 937, size=20).tolist()
    mix = [("a", 3.0, 500), ("b", 0.0, 10), ("c", 1.0, 900)]
    one = sample.indexed_draws(spark, 400, mix, 64, 9).orderBy("window").collect()
    two = sample.indexed_draws(spark.newSession(), 400, mix, 64, 9).repartition(3).orderBy("window").collect()
    assert one == two and {r["source"] for r in one} == {"a", "c"}
    assert abs(sum(r["source"] == "a" for r in one) / 400 - 0.75) < 0.1


def test_running_sums_of_any_order(spark):
    """Nulls first, ties by row, columns with names used inside, groups with a null key."""
    rows = [(k, v, "x" * (i % 3)) for i, (k, v) in enumerate([(None, 3), (1, 4), (1, 4), (1, 4), (2**60, 1), (-5, 9), (None, None), (7, 2)])]
    d = spark.createDataFrame(rows, "k long, value long, part string")
    got = storage.running(d, "k", F.col("value"), "end").collect()
    assert len(got) == len(rows) and max(r["end"] for r in got) == 27 and {r["end"] for r in got if r["k"] is None} <= {0, 3}
    last = {r["k"]: r["end"] for r in sorted(got, key=lambda r: r["end"])}
    assert (last[-5], last[1], last[7], last[2**60]) == (12, 24, 26, 27) and got[0].asDict().keys() == {"k", "value", "part", "end"}
    groups = storage.numbered(d, "k", "i", ("part",)).groupBy("part").agg(F.sort_array(F.collect_list("i")).alias("i")).collect()
    assert all(r["i"] == list(range(len(r["i"]))) for r in groups) and len(groups) == 3


def test_encode_with_a_vocabulary_in_parts(spark, monkeypatch):
    """Frequent pieces are broadcast, rare ones joined: the same ids, and back."""
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (3, ""), (4, "c, d e a b zz"), (4, "a")], "doc_id long, text string")
    vocab = plans.vocabulary(docs)
    ids = {r["piece"]: r["token"] for r in vocab.collect()}
    assert [ids[p] for p in "abc"] == [3, 4, 5]
    for limit in (1 << 20, 2):
        monkeypatch.setattr(plans, "BROADCAST_PIECES", limit)
        got = sorted((r["doc_id"], r["tokens"]) for r in plans.encode(docs, vocab).collect())
        assert got == [(1, [ids[p] for p in "abca"]), (2, []), (3, []), (4, [3]), (4, [ids[p] for p in ["c", ",", "d", "e", "a", "b", "zz"]])]
        text = {tuple(r["tokens"]): r["decoded"] for r in plans.decode(plans.encode(docs, vocab), vocab).collect()}
        assert text[tuple(ids[p] for p in "abca")] == "a b c a" and text[()] == ""
        capped = [r["tokens"] for r in plans.encode(docs.where("doc_id = 1"), vocab, cap=2).collect()]
        assert capped == [[3, 4, 0, 3]]
