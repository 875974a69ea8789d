"""What tasks hold and move doesn't grow with batches, vocabularies or tables."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tokenloom import plans, queries, sinks, storage
from tokenloom.operators import inspect, source, stats


class Task:
    """Stands for a data frame: gives back the function of a mapInArrow, to be called here."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, schema):
        return f


def test_slices_of_a_batch():
    b = pa.RecordBatch.from_pydict({"x": list(range(7))})
    cut = [x.column(0).to_pylist() for x in storage.portions(b, np.array([1, 1, 9, 0, 2, 2, 5]), 4)]
    assert cut == [[0, 1], [2], [3, 4, 5], [6]]
    assert list(storage.portions(b.slice(0, 0), np.zeros(0, int), 4)) == []


def test_small_batches_end(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), storage.small_batches(spark, 10):
        assert spark.conf.get(key) == "10"
        1 / 0
    assert spark.conf.get(key) == was


def test_f1_the_tokenizer_gets_little_at_a_time(spark):
    class Counting:
        """Every token is the number of bytes in its call."""

        def encode_batch(self, texts):
            return [np.array([sum(map(len, texts))], np.int64) for _ in texts]

    by_value = cloudpickle.dumps(Counting())

    class Travelling:
        def __reduce__(self):
            return cloudpickle.loads, (by_value,)

    docs = spark.range(4000).coalesce(1).select(F.col("id").alias("input_index"), F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 1000).cast("binary").alias("raw"), F.lit(None).cast("string").alias("unreadable"))
    most, n = sinks.encode_documents(docs, Travelling(), 1 << 40).agg(F.max(F.col("tokens")[0]), F.count("tokens")).first()
    assert most <= 1 << 20 and n == 4000


@pytest.fixture
def stored(tmp_path):
    items = np.arange(1 << 21, dtype="<u4")
    items.tofile(tmp_path / "train-00000.bin")
    return source.Source(str(tmp_path), "train", len(items), 1, "uint32", [0, len(items)], ["train-00000.bin"], "")


def test_f5_windows_are_handed_on_in_parts(spark, stored):
    n, length = 64, 1 << 15
    wanted = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([i * length for i in range(n)], pa.int64()), pa.array([length] * n, pa.int64())], ["window", "start", "length"])
    parts = list(stored.windows(Task())(iter([wanted])))
    assert max(len(b.column(2).flatten()) for b in parts) <= 1 << 20
    assert np.concatenate([b.column(2).flatten().to_numpy() for b in parts]).tolist() == list(range(n * length))


def test_f2_decoding_moves_the_rare_pieces_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (4, "c, d e a b zz"), (5, "a")], "doc_id long, text string")
    vocab = storage.materialize(plans.vocabulary(docs), "vocabulary")
    monkeypatch.setattr(plans, "BROADCAST_PIECES", 2)
    monkeypatch.setattr(plans, "AT_ONCE", 3)
    coded = storage.materialize(plans.encode(docs, vocab), "coded")
    with_key = lambda: plans.decode(coded.withColumn("tokens", F.concat("tokens", F.array(F.lit(1).cast("long"), F.lit(10**6).cast("long")))), vocab, "doc_id")
    monkeypatch.setattr(plans, "materialize", lambda *_: pytest.fail("the documents are written again"))
    assert {r["doc_id"]: r["decoded"] for r in with_key().collect()} == {1: "a b c a", 2: "", 4: "c , d e a b zz", 5: "a"}


def test_f7_encoding_stores_the_rare_pieces_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c a"), (2, None), (4, "c a a b zz c"), (5, "a a b")], "doc_id long, text string")
    vocab = storage.materialize(plans.vocabulary(docs), "vocabulary")
    ids = {r["piece"]: r["token"] for r in vocab.collect()}
    written = []
    monkeypatch.setattr(plans, "BROADCAST_PIECES", 2)
    monkeypatch.setattr(plans, "materialize", lambda df, name: written.append(storage.materialize(df, name)) or written[-1])
    got = {r["doc_id"]: r["tokens"] for r in plans.encode(docs, vocab).collect()}
    assert got == {1: [ids[p] for p in "abca"], 2: [], 4: [ids[p] for p in ["c", "a", "a", "b", "zz", "c"]], 5: [ids[p] for p in "aab"]}
    assert sum(len(r["pieces"]) for r in written[0].collect()) == 4
    assert plans.encode(docs, vocab, cap=2, with_text=False).columns == ["doc_id", "tokens"]


def test_f4_one_pass_for_both_counts(spark, monkeypatch):
    written = []
    real = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, name: written.append(name) or real(df, name))
    d = spark.createDataFrame([(i, "D203" if i % 3 == 0 else None) for i in range(9)], "doc_id long, code string")
    got = [(r["n_input"], r["n_skipped"], r["tripped"]) for r in stats.skip_guard(d, "doc_id", 0.4, 2).orderBy("doc_id").collect()]
    assert written == ["ordered"]
    assert got == [(i + 1, i // 3 + 1, i + 1 >= 2 and (i // 3 + 1) / (i + 1) > 0.4) for i in range(9)]


def test_f4_tokens_are_written_three_times(spark, sf, monkeypatch):
    """Documents as they are encoded, in their places, and in chunks: not for each running sum."""
    wide = []
    real = storage.materialize

    def seen(df, name):
        wide.extend([name] * any(t.startswith("array<bigint>") for _, t in df.dtypes))
        return real(df, name)

    for m in (storage, plans, queries, __import__("tokenloom.corpus", fromlist=["x"])):
        monkeypatch.setattr(m, "materialize", seen)
    c = queries.write_corpus(queries.documents(spark, sf).limit(50).select("doc_id", "text"), size=100)
    assert wide == ["encoded", "docs", "chunks"]
    assert c.n_docs == 50 and c.chunks.agg(F.sum(F.size("tokens"))).first()[0] == c.n_items


def test_a_long_document_is_cut_in_its_row(spark):
    rows = [(1, 0, 7, list(range(7))), (2, 7, 30, list(range(7, 30))), (3, 30, 30, [])]
    d = spark.createDataFrame(rows, "doc_id long, start long, end long, items array<bigint>")
    for span in (None, 2):
        got = {r["chunk"]: (r["lo"], r["tokens"]) for r in plans.chunks(d, 4, span=span).collect()}
        assert got == {k: (4 * k, list(range(4 * k, min(30, 4 * k + 4)))) for k in range(8)}


@pytest.mark.parametrize("name", ["rejects_by_code", "write_stats", "skip_ratio_guard"])
def test_f8_f9_checks_of_repeated_and_null_ids(spark, tmp_path, monkeypatch, name):
    """Once the corpus is stored, no text is read again; ids that repeat give a row each, as in SQL."""
    docs = [(1, "a b"), (1, "a b c"), (97, "c c"), (5, ""), (6, "d, e f"), (7, None)] + ([] if name == "skip_ratio_guard" else [(None, "a"), (5, "b c")])
    spark.createDataFrame([(i, t, "en", "web") for i, t in docs], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (6, 1), (6, 0)], "doc_id long, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    read = []
    real = stats.classified
    monkeypatch.setattr(stats, "classified", lambda d, top: read.extend(d.inputFiles()) or real(d, top))
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert any("labels" in x for x in read) and not any("documents.parquet" in x for x in read)
    if name == "rejects_by_code":
        c = duckdb.connect()
        for t in ("documents", "labels"):
            c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        # a null text has no pieces, in SQL a null length: it is checked as an empty one
        r = c.execute(queries.ORACLE[name].replace("from documents)", "from (select * replace (coalesce(text, '') as text) from documents))", 1))
        at = [[d[0] for d in r.description].index(x) for x in columns]
        assert got == Counter(tuple(x[i] for i in at) for x in r.fetchall())
    else:
        assert sum(got.values()) == (1 if name == "write_stats" else len(docs))


def test_f3_f6_files_of_many_shards(spark, tmp_path):
    """Packed in parts, every shard is the stream's bytes, and verification says so."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "<|endoftext|>": 1} | {f"t{i}": i + 2 for i in range(300)}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 300, int(m)).tolist() for m in rng.integers(1, 400, 300)]
    docs = spark.createDataFrame([(i, f"d{i}", " ".join(f"t{x}" for x in w).encode(), None) for i, w in enumerate(words)], "input_index long, id string, raw binary, unreadable string").repartition(3)
    work = Path(storage.work_dir(spark).removeprefix("file://"))
    before = {p.name for p in work.glob("*") if p.name.startswith(("encoded-", "placed-"))}
    out = sinks.write_split(docs, str(tmp_path), "a", t, sinks.WriterConfig(shard_bytes=1000))
    assert {p.name for p in work.glob("*") if p.name.startswith(("encoded-", "placed-"))} == before
    flat = np.array([x for w in words for x in [*(i + 2 for i in w), 1]], "<u2").tobytes()
    shards = source.read_meta(Path(tmp_path) / "a")["splits"]["train"]["shards"]
    assert [s["sha256"] for s in shards] == [hashlib.sha256(flat[i : i + 1000]).hexdigest() for i in range(0, len(flat), 1000)]
    assert out.stats["n_docs"] == 300 and {r["status"] for r in inspect.verify_source(spark, tmp_path / "a").collect()} == {"ok"}


def test_f3_ids_are_checked_in_parts(spark, tmp_path, monkeypatch):
    """Lines are held a few bytes at a time, and places outside of the file are reported, not read."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "<|endoftext|>": 1}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    docs = spark.createDataFrame([(i, "d" * (i % 4 * 9 + 1), b"a b", None) for i in range(9)], "input_index long, id string, raw binary, unreadable string")
    sinks.write_split(docs, str(tmp_path), "a", t)
    monkeypatch.setattr(inspect, "STEP", 2)
    monkeypatch.setattr(inspect, "TEXT_STEP", 7, raising=False)
    at = tmp_path / "a" / "train-ids.npy"
    good = np.load(at)

    def told(change: dict[int, int]) -> str:
        v = good.copy()
        for i, x in change.items():
            v[i] = x
        np.save(at, v)
        return {r["file"]: r["status"] for r in inspect.verify_source(spark, tmp_path / "a").collect()}[at.name]

    assert told({}) == "ok"
    for change in ({3: good[3] + 1}, {8: good[8] - 1}, {2: 10**15, 3: 10**15 + 1}, {1: -20, 2: -10}):
        assert told(change) == "wrong_values"


@pytest.mark.parametrize("name, wide", [("rejects_by_code", ["encoded", "docs"]), ("token_frequencies", ["encoded", "docs", "chunks"])])
def test_f9_chunks_are_written_when_they_are_read(spark, sf, monkeypatch, name, wide):
    seen = []
    real = storage.materialize
    for m in (storage, plans, queries, __import__("tokenloom.corpus", fromlist=["x"])):
        monkeypatch.setattr(m, "materialize", lambda df, name: seen.extend([name] * any(t.startswith("array<bigint>") for _, t in df.dtypes)) or real(df, name))
    monkeypatch.setattr(queries, "_WRITTEN", {})
    assert queries.QUERIES[name](spark, sf).count() > 0 and seen == wide
