"""Split files: written, read back, verified."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom import sinks
from tokenloom.errors import EngineError


def tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    ids = {"[UNK]": 0, "<|endoftext|>": 1, "<s>": 2} | {f"t{i}": i + 3 for i in range(300)}
    t = Tokenizer(models.WordLevel(ids, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    return t


def documents(spark, n, seed, longest=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.integers(1, longest + 1))
        rows.append((i, f"doc-{i}", " ".join(f"t{w}" for w in rng.integers(0, 300, size=size)).encode(), None))
    return rows, spark.createDataFrame(rows, "input_index long, id string, raw binary, unreadable string")


def expected(rows):
    return [x for _, _, raw, _ in rows for x in [*(int(w[1:]) + 3 for w in raw.decode().split()), 1]]


def test_files_have_known_hashes(spark, tmp_path):
    """Two splits of one source; the hashes of their shards are given."""
    rows, train = documents(spark, 40, 1)
    _, valid = documents(spark, 5, 2)
    got = sinks.write_split(train, tmp_path, "tiny", tokenizer(), sinks.WriterConfig(shard_bytes=256))
    assert got.status == "complete" and got.stats == {"n_input": 40, "n_docs": 40, "n_skipped": 0, "n_items": 303, "n_shards": 3, "n_split_docs": 2}
    sinks.write_split(valid, tmp_path, "tiny", tokenizer(), sinks.WriterConfig("valid", 256))
    meta = json.loads((tmp_path / "tiny" / "meta.json").read_text())
    assert [s["sha256"][:12] for s in meta["splits"]["train"]["shards"]] == ["064b836c031d", "3e293714f423", "196920866ea5"]
    assert [s["sha256"][:12] for s in meta["splits"]["valid"]["shards"]] == ["bea9aad980ac"] and list(meta["splits"]) == ["train", "valid"]
    assert meta["tokenizer_hash"] == "5b6c9ce06a2c8850" and meta["dtype"] == "uint16"
    flat = np.concatenate([np.fromfile(tmp_path / "tiny" / s["name"], "<u2") for s in meta["splits"]["train"]["shards"]])
    assert flat.tolist() == expected(rows)
    offsets = np.load(tmp_path / "tiny" / "train-offsets.npy")
    assert offsets[0] == 0 and offsets[-1] == 303 and len(offsets) == 41
    index, lines = np.load(tmp_path / "tiny" / "train-ids.npy"), (tmp_path / "tiny" / "train-ids.jsonl").read_bytes()
    assert [json.loads(lines[a:b])["id"] for a, b in zip(index, index[1:])] == [r[1] for r in rows] and not list(tmp_path.glob("*.partial"))
    with pytest.raises(EngineError, match="C306"):
        sinks.write_split(train, tmp_path, "tiny", tokenizer())


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows, docs = documents(spark, 40, 1)
    sinks.write_split(docs, root, "web", tokenizer(), sinks.WriterConfig(shard_bytes=256))
    os.system(f"cp -r {root}/web {root}/code")
    return root, rows, expected(rows)


def test_every_window_of_files(spark, tiny):
    from tokenloom.operators.source import read_source

    root, rows, flat = tiny
    s = read_source(root / "web")
    want = spark.range(len(flat) + 1).select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(80), F.lit(5))).alias("length")).where(F.col("start") + F.col("length") <= len(flat))
    got = s.windows(want.select((F.col("start") * 100 + F.col("length")).alias("window"), "start", "length")).collect()
    assert len(got) > 4000 and all(r["tokens"] == flat[r["start"] : r["start"] + r["window"] % 100] for r in got)
    for a, b, step in [(None, None, 1), (3, -4, 5), (None, None, -3), (250, 2, -7), (10, 5, 1), (-5, 1000, 2)]:
        assert s[a:b:step].tolist() == flat[a:b:step]
    assert s[-1] == 1 and s[0] == flat[0] and s.id_of_doc(-1) == "doc-39"
    docs = s.docs(spark, 7).orderBy("doc_index").collect()
    assert [r["id"] for r in docs] == [r[1] for r in rows] and s.doc(5).tolist() == flat[docs[5]["start"] : docs[5]["end"]]
    assert [t for r in s.chunks(spark, 50).orderBy("chunk").collect() for t in r["tokens"]] == flat
    grid = s.grid(spark, 64, 30).orderBy("window").collect()
    assert [r["tokens"] for r in grid] == [flat[i : i + 64] for i in range(0, len(flat) - 63, 30)]
    picked = s.sample_windows(spark, 9, 20, np.random.default_rng(4)).orderBy("window").collect()
    assert [r["start"] for r in picked] == np.random.default_rng(4).integers(0, len(flat) - 19, size=9).tolist()
    for wrong in (True, 1.5, "1"):
        with pytest.raises(EngineError, match="C301"):
            s.window(wrong, 1)
    with pytest.raises(EngineError, match="C304"):
        s.window(300, 4)


def test_mixture_batches(spark, tiny):
    from tokenloom.operators.mixture import Mixture, write_mix

    root, _, flat = tiny
    write_mix(root, {"web": 3, "code": 1})
    m = Mixture.open(root)
    assert m.p.tolist() == [0.75, 0.25] and m.dtype == "uint16"
    got = m.batch(spark, 32, 16, np.random.default_rng(8)).orderBy("row").collect()
    rng = np.random.default_rng(8)
    chosen = rng.choice(2, size=32, p=[0.75, 0.25])
    starts = np.zeros(32, int)
    for k in (0, 1):
        starts[chosen == k] = rng.integers(0, len(flat) - 15, size=int((chosen == k).sum()))
    assert [(r["source"], r["start"], r["tokens"]) for r in got] == [(("web", "code")[k], s, flat[s : s + 16]) for k, s in zip(chosen, starts)]
    one, two = (m.indexed(spark, n, 16, seed=2).where("row < 10").orderBy("row").collect() for n in (10, 40))
    assert one == two and all(r["tokens"] == flat[r["start"] : r["start"] + 16] for r in one)
    for weights, code in (({}, "F109"), ({"web": True}, "F109"), ({"web": -1}, "F109"), ({"web": 0.0}, "F109"), ({"nope": 1}, "C305"), ({"a/b": 1}, "C305")):
        with pytest.raises(EngineError, match=code):
            Mixture.open(root, weights)
    assert [n for n, _ in Mixture.open(root, {"code": 2, "web": 0}).sources] == ["code"]


def test_verify_and_inspect(spark, tiny, tmp_path):
    from tokenloom.operators import inspect as ins

    root, _, flat = tiny
    os.system(f"cp -r {root}/web {tmp_path}/web")
    home = tmp_path / "web"
    report = ins.verify_report(ins.verify_source(spark, home))
    assert report["ok"] and report["n_files"] == 6 and ins.inspect_corpus(tmp_path)["ready"]
    shard = home / "train-00001.bin"
    raw = bytearray(shard.read_bytes())
    raw[5] ^= 1
    shard.write_bytes(raw)
    offsets = np.load(home / "train-offsets.npy")
    offsets[7], offsets[8] = offsets[8], offsets[7]
    np.save(home / "train-offsets.npy", offsets)
    (home / "train-00002.bin").unlink()
    bad = {r["file"]: r["status"] for r in ins.verify_report(ins.verify_source(spark, home))["bad"]}
    assert bad == {"train-00001.bin": "wrong_hash", "train-00002.bin": "missing", "train-offsets.npy": "wrong_values"}
    found = ins.inspect_source(home)
    assert found["state"] == "corrupt" and found["n_items"] == len(flat) and not ins.inspect_corpus(tmp_path)["ready"]
    (tmp_path / "web.partial").mkdir()
    assert ins.clean_source(home) == ["web.partial"] and ins.source_names(tmp_path) == ["web"]
    ins.remove_source(home)
    assert not list(tmp_path.iterdir()) and ins.doctor()["packages"]["numpy"]


def test_skips_and_resume(spark, tmp_path, monkeypatch):
    """Bad documents by code; a write that broke off goes on, and not with other inputs or settings."""
    rows = [(0, "a", b"t1 t2", None), (1, "b", b"t1 \xff t2", None), (2, "c", b"", None), (3, "d", b"   ", None), (4, "e", b"t3 " * 70, None), (5, "f", None, "broken"), (6, "a", b"t9", None)]
    schema = "input_index long, id string, raw binary, unreadable string"
    docs, config = spark.createDataFrame(rows, schema), sinks.WriterConfig(shard_bytes=48, prepend_bos=True)
    real = sinks.atomic_json

    def fail(path, value):
        if path.name == "train-00001.bin.json":
            raise KeyboardInterrupt
        real(path, value)

    monkeypatch.setattr(sinks, "atomic_json", fail)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_split(docs, tmp_path, "s", tokenizer(), config)
    monkeypatch.setattr(sinks, "atomic_json", real)
    for other, other_config in ((docs.where("input_index <> 4"), config), (docs, sinks.WriterConfig(shard_bytes=50, prepend_bos=True))):
        with pytest.raises(EngineError, match="R20"):
            sinks.write_split(other, tmp_path, "s", tokenizer(), other_config)
    got = sinks.write_split(docs, tmp_path, "s", tokenizer(), config)
    assert got.resumed_shards == 1 and got.status == "complete_with_issues"
    assert {(c, n) for c, _, _, n in got.issues} == {("D201", 1), ("D203", 2), ("D206", 1), ("D205", 1), ("S201", 1), ("S202", 2)}
    skipped = [json.loads(x) for x in (tmp_path / "s" / "train-skipped.jsonl").read_text().splitlines()]
    assert [(x["input_index"], x["code"]) for x in skipped] == [(1, "D201"), (2, "D203"), (3, "D203"), (5, "D206")]
    flat = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "s").glob("train-*.bin"))]).tolist()
    assert flat == [2, 4, 5, 1, 2, *[6] * 70, 1, 2, 12, 1]
    for policy, code in ((sinks.ErrorPolicy("raise"), "D201"), (sinks.ErrorPolicy(max_skip_ratio=0.3, min_docs_for_ratio=3), "K204")):
        with pytest.raises(EngineError, match=code):
            sinks.write_split(docs, tmp_path, "other", tokenizer(), config, policy)
    empty = sinks.write_split(docs.where("false"), tmp_path, "none", tokenizer(), config)
    assert empty.stats["n_shards"] == 0 and empty.status == "complete"


def test_text_inputs(spark, tmp_path):
    from tokenloom import sources

    for name, raw in (("b.txt", b"bb"), ("A.txt", b"aa"), ("sub/a.txt", b"sa"), ("sub/Z/x.txt", b"zx"), (".h.txt", b"h"), ("notes.md", b"no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = sources.txt_dir(spark, str(tmp_path)).orderBy("input_index").collect()
    assert [(r["id"], bytes(r["raw"])) for r in got] == [(".h.txt", b"h"), ("A.txt", b"aa"), ("b.txt", b"bb"), ("sub/Z/x.txt", b"zx"), ("sub/a.txt", b"sa")]
    lines = [b'{"text": "one"}', b"", b"not json", b'["list"]', b'{"other": 1}', b'{"text": 5}', b"  ", b'{"text": "two\\r"}\r', b'{"text": "\\ud800"}']
    (tmp_path / "a.jsonl").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "b.jsonl").write_bytes(b'{"text": "three"}')
    got = sources.jsonl(spark, str(tmp_path)).orderBy("input_index").collect()
    assert [(r["input_index"], r["id"]) for r in got] == [(i, x) for i, x in enumerate(["a.jsonl:0", "a.jsonl:2", "a.jsonl:3", "a.jsonl:4", "a.jsonl:5", "a.jsonl:7", "a.jsonl:8", "b.jsonl:0"])]
    assert [r["raw"] and bytes(r["raw"]) for r in got] == [b"one", None, None, None, None, b"two\r", b"\xed\xa0\x80", b"three"]
    assert sources.jsonl(spark, str(tmp_path / "b.jsonl")).collect()[0]["id"] == "b.jsonl:0"
    for bad in ("missing", "sub"):
        with pytest.raises(EngineError, match="C311"):
            sources.jsonl(spark, str(tmp_path / bad))


def test_pack_and_unpack(spark, tiny, tmp_path):
    import tarfile

    from tokenloom.operators import pack

    root, _, _ = tiny
    same = lambda a, b: {p.relative_to(a): p.read_bytes() for p in a.rglob("*") if p.is_file()} == {p.relative_to(b): p.read_bytes() for p in b.rglob("*") if p.is_file()}
    for method, tar in (("zstd", False), ("lzma", True), ("none", True)):
        at = tmp_path / f"{method}.tlpack"
        pack.pack_source(spark, root / "web", at, method, tar=tar)
        pack.unpack_source(spark, at, tmp_path / f"back-{method}")
        assert same(root / "web", tmp_path / f"back-{method}")
    assert pack.manifest_files(spark, tmp_path / "zstd.tlpack").count() == len(list((root / "web").rglob("*.*")))
    (tmp_path / "zstd.tlpack" / "train-00000.bin").write_bytes(b"x")
    with pytest.raises(EngineError, match="P106"):
        pack.unpack_source(spark, tmp_path / "zstd.tlpack", tmp_path / "no")
    assert not (tmp_path / "no").exists() and not list(tmp_path.glob("no.*"))
    for names, kind in ((["a.tlpack/../x"], None), (["/a.tlpack/x"], None), (["a.tlpack/x", "b.tlpack/y"], None), (["a.tlpack/x", "a.tlpack/x"], None), (["a/x"], None), (["a.tlpack/l"], tarfile.SYMTYPE), (["a.tlpack/l"], tarfile.LNKTYPE), (["a.tlpack/d"], tarfile.CHRTYPE), (["C:a.tlpack/x"], None), (["a.tlpack\\x"], None)):
        with tarfile.open(tmp_path / "evil.tar", "w") as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.type, info.linkname = kind or tarfile.REGTYPE, "/etc/passwd"
                t.addfile(info)
        with pytest.raises(EngineError, match="P10[14]"):
            pack.unpack_source(spark, tmp_path / "evil.tar", tmp_path / "no")


def test_command_line(spark, tiny, tmp_path, capsys):
    from tokenloom import cli

    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_text(f"t{i} t{i + 1}")
    tokenizer().save(str(tmp_path / "tok.json"))
    source = str(tmp_path / "c" / "src")
    (tmp_path / "c").mkdir()
    assert cli.main(["--json", "build", source, "--input", str(tmp_path / "in"), "--tokenizer", str(tmp_path / "tok.json"), "--shard-bytes", "1K"]) == 0
    assert json.loads(capsys.readouterr().out)["result"]["stats"]["n_items"] == 15
    assert cli.main(["info", source]) == 0 and cli.main(["ls", str(tmp_path / "c")]) == 0 and cli.main(["verify", source]) == 0 and cli.main(["doctor"]) == 0 and cli.main(["migrate", source]) == 0
    (tmp_path / "c" / "src" / "train-00000.bin").write_bytes(b"")
    assert cli.main(["verify", source]) == 1 and cli.main(["rm", source]) == 2 and cli.main(["rm", source, "--yes"]) == 0
    assert cli.main(["info", source]) == 3 and cli.main(["nonsense"]) == 2 and cli.parse_size("3M") == 3 << 20
