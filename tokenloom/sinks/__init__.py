"""Split files: fixed-size shards of little-endian items, document offsets, ids and skipped documents.

A split is written by tasks at positions that running sums give, so parts are written side by side and a task that is
run again writes the same bytes to the same place. The folder is one that all executors share. Layout of a source:

    meta.json, tokenizer/tokenizer.json
    {split}-{k:05d}.bin      items k * S .. (k + 1) * S of the stream, the last shard shorter
    {split}-offsets.npy      int64, n_docs + 1: where each document starts, and the end
    {split}-ids.jsonl, {split}-ids.npy    {"id": ...} per document, and where each line starts
    {split}-skipped.jsonl    {"input_index", "id", "code", "reason"} per skipped document

Work goes on in `<source>.partial`; a shard that is whole is listed in `done/`, so a write that was interrupted
goes on with the missing shards if settings, tokenizer and inputs are the same. At the end the folder is renamed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plans
from ..errors import SKIP_REASONS, EngineError, integer
from ..storage import discard, materialize, portions, running, running_sums, small_batches
from ..tokenizers import HubTokenizer, canonical, item_type, resolve

SPLITS = ("train", "valid", "test")
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")
SCHEMA_VERSION = 1
#: Bytes of text that a worker encodes at a time, and items that it packs.
TEXT_AT_ONCE, ITEMS_AT_ONCE = 1 << 20, 1 << 20


@dataclass(frozen=True)
class WriterConfig:
    """What the files of a split depend on."""

    split: str = "train"
    shard_bytes: int = 512 << 20
    append_eos: bool = True
    prepend_bos: bool = False
    dtype: str | None = None
    eos_token: str | None = None
    bos_token: str | None = None

    def __post_init__(self) -> None:
        if self.split not in SPLITS:
            raise EngineError("C304", f"there is no split {self.split!r}", fix="use train, valid or test")
        integer(self.shard_bytes, "shard_bytes", 16)

    def digest(self) -> str:
        return hashlib.sha256(canonical(asdict(self)).encode()).hexdigest()


@dataclass(frozen=True)
class ErrorPolicy:
    """Bad documents are skipped (or raise), up to a share of the inputs so far."""

    on_data_error: str = "skip"
    max_skip_ratio: float = 0.01
    min_docs_for_ratio: int = 1000


@dataclass
class WriteResult:
    """status: complete, or complete_with_issues if there was a warning. issues: (code, level, message, count)."""

    status: str
    stats: dict
    issues: list[tuple[str, str, str, int]] = field(default_factory=list)
    resumed_shards: int = 0

    def to_dict(self) -> dict:
        return asdict(self)


def valid_name(name: str) -> str:
    if not NAME.fullmatch(name) or name.endswith(".partial"):
        raise EngineError("C305", f"{name!r} is no name of a source")
    return name


def atomic_json(path: Path, value: object) -> None:
    temporary = path.with_name(f".{path.name}.{os.getpid()}")
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def encode_documents(docs: DataFrame, tokenizer: HubTokenizer, top: int) -> DataFrame:
    """docs (input_index, id, raw, unreadable) -> input_index, id, tokens, code, reason: null for documents that are
    kept, else why not. A call of the tokenizer gets TEXT_AT_ONCE bytes, or one document, as its encodings take many times the text; one
    that it refuses is encoded one by one, so only the culprits go."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def one(raw: bytes | None, unreadable: str | None) -> tuple[str | None, str | None, str | None]:
        """Text, code, reason."""
        if unreadable is not None:
            return None, "D206", unreadable
        try:
            text = (raw or b"").decode()
        except UnicodeDecodeError as e:
            return None, "D201", f"byte 0x{raw[e.start]:02x} at position {e.start}: {e.reason}"
        return (text, None, None) if text else (None, "D203", SKIP_REASONS["D203"])

    def tokens(texts: list[str]) -> list[np.ndarray | Exception]:
        try:
            return list(shared.value.encode_batch(texts))
        except Exception as e:  # noqa: BLE001
            return [e] if len(texts) == 1 else [x for t in texts for x in tokens([t])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, pc.binary_length(whole.column(2)).fill_null(0).to_numpy(zero_copy_only=False), TEXT_AT_ONCE):
                read = [one(*x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                live = [i for i, x in enumerate(read) if x[0] is not None]
                got = dict(zip(live, tokens([read[i][0] for i in live]))) if live else {}
                out, codes, why = [], [], []
                for i, (_, code, reason) in enumerate(read):
                    ids = got.get(i)
                    if isinstance(ids, Exception):
                        code, reason, ids = "D204", f"{type(ids).__name__}: {ids}", None
                    elif ids is not None and not len(ids):
                        code, reason, ids = "D203", SKIP_REASONS["D203"], None
                    elif ids is not None and (ids.min() < 0 or ids.max() > top):
                        code, reason, ids = "D202", SKIP_REASONS["D202"], None
                    out.append(ids)
                    codes.append(code)
                    why.append(reason)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(codes, pa.string()), pa.array(why, pa.string())], ["input_index", "id", "tokens", "code", "reason"])

    return docs.select("input_index", "id", "raw", "unreadable").mapInArrow(rows, "input_index long, id string, tokens array<bigint>, code string, reason string")


def _preallocate(path: Path, size: int) -> None:
    with open(path, "ab"):
        os.truncate(path, size)


def _put(df: DataFrame, folder: str) -> int:
    """Write the rows (file, at, bytes) into files of the folder, each at its place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, int] = {}
        try:
            for b in batches:
                for i, (name, at) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    if name not in files:
                        if len(files) >= 64:
                            os.close(files.pop(next(iter(files))))
                        files[name] = os.open(f"{folder}/{name}", os.O_WRONLY)
                    os.pwrite(files[name], b.column(2)[i].as_buffer(), at)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])
        finally:
            for f in files.values():
                os.fsync(f)
                os.close(f)

    return df.select("file", "at", "bytes").mapInArrow(rows, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _npy_head(n: int) -> bytes:
    import io

    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"descr": "<i8", "fortran_order": False, "shape": (n,)})
    return f.getvalue()



def _column_file(df: DataFrame, index: str, value: str, name: str, folder: Path, n: int) -> None:
    """An .npy file of n values from rows (index, value), written by tasks."""
    head = _npy_head(n)
    at = folder / name
    at.write_bytes(head)
    _preallocate(at, len(head) + 8 * n)
    start = len(head)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, v = b.column(0).to_numpy(), b.column(1).to_numpy().astype("<i8")
            cut = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1] + 1) + 1, [len(i)]]) if len(i) else np.zeros(0, int)
            runs = [(name, start + 8 * int(i[x]), v[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), (pa.string(), pa.int64(), pa.binary()))], ["file", "at", "bytes"])

    _put(df.select(index, value).sortWithinPartitions(index).mapInArrow(rows, "file string, at long, bytes binary"), str(folder))


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def hash_files(spark, paths: list[str]) -> dict[str, str | None]:
    """SHA-256 of each file, a task for each; None for one that is not there."""
    if not paths:
        return {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([file_sha256(p) if os.path.isfile(p) else None], pa.string())], ["path", "sha256"])

    listed = spark.createDataFrame(pa.table({"path": paths})).repartition(min(len(paths), 8 * spark.sparkContext.defaultParallelism), "path")
    return {r["path"]: r["sha256"] for r in listed.mapInArrow(rows, "path string, sha256 string").collect()}


def write_split(docs: DataFrame, root: str, name: str, tokenizer: object, config: WriterConfig = WriterConfig(), policy: ErrorPolicy = ErrorPolicy(), overwrite: bool = False) -> WriteResult:
    """Write documents (input_index, id, raw, unreadable) as a split of the source root/name."""
    spark = docs.sparkSession
    home = Path(root) / valid_name(name)
    old = json.loads((home / "meta.json").read_text()) if (home / "meta.json").is_file() else None
    if old and config.split in old["splits"] and not overwrite:
        raise EngineError("C306", f"{home} has a split {config.split}", fix="overwrite=True replaces it")
    tok = resolve(tokenizer, config.eos_token, config.bos_token)
    dtype = item_type(tok.vocab_size, config.dtype or (old or {}).get("dtype"))
    if old and (old["tokenizer_hash"] != tok.fingerprint() or old["dtype"] != dtype):
        raise EngineError("K208", "the source has another tokenizer or item type", fix="write to another source")
    if config.append_eos and tok.eos_id is None:
        raise EngineError("K209", "the tokenizer has no end-of-text token", fix="give eos_token, or append_eos=False")
    if config.prepend_bos and tok.bos_id is None:
        raise EngineError("K209", "the tokenizer has no begin-of-text token", fix="give bos_token, or prepend_bos=False")
    width = np.dtype(dtype).itemsize
    per = config.shard_bytes // width
    if not per:
        raise EngineError("C307", "a shard holds no item", fix="a greater shard_bytes")

    with small_batches(spark):
        coded = materialize(encode_documents(docs, tok, (1 << 8 * width) - 1).withColumn("row", F.monotonically_increasing_id()), "encoded")
    _guard(coded, policy)
    extra = int(config.append_eos) + int(config.prepend_bos)
    # places are worked out without the tokens, which are then moved once
    tie = F.xxhash64("input_index", "id", "tokens").alias("tie")
    sized = coded.where("code is null").select("row", "input_index", tie, (F.size("tokens").cast("long") + extra).alias("n_items"))
    places = running_sums(sized, ["input_index", "tie"], {"end": F.col("n_items"), "doc_index": F.lit(1)}).drop("input_index", "tie")
    places = places.withColumns({"start": F.col("end") - F.col("n_items"), "doc_index": F.col("doc_index") - 1})
    one = lambda v: F.array(F.lit(v).cast("long"))
    parts = [*([one(tok.bos_id)] if config.prepend_bos else []), F.col("tokens"), *([one(tok.eos_id)] if config.append_eos else [])]
    kept = coded.where("code is null").select("row", "input_index", "id", "tokens")
    placed = materialize(kept.join(places, "row").withColumn("items", F.concat(*parts)).drop("tokens", "row"), "placed")
    n_items, n_docs, biggest = placed.agg(F.coalesce(F.max("end"), F.lit(0)), F.count("*"), F.coalesce(F.max("n_items"), F.lit(0))).first()
    n_input, digest, n_ids = coded.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("input_index", "id", "tokens", "code").cast("decimal(38,0)")), F.lit(0)).cast("string"), F.count("id")).first()
    if n_ids not in (0, n_input) and coded.where("id is null and code is null").limit(1).count():
        raise EngineError("K202", "some documents have an id and some have none", fix="give ids to all or to none")

    work = Path(f"{home}.partial")
    plan = {"config": config.digest(), "tokenizer": tok.fingerprint(), "dtype": dtype, "n_items": n_items, "n_input": n_input, "input": digest}
    resumed = _start(work, plan)
    shards = [f"{config.split}-{k:05d}.bin" for k in range(-(-n_items // per))]
    done = {p.name.removesuffix(".json"): json.loads(p.read_text()) for p in (work / "done").glob("*.json")}
    for stray in set(done) - set(shards):
        (work / "done" / f"{stray}.json").unlink()
    missing = [k for k, s in enumerate(shards) if s not in done or not (work / s).is_file()]
    for k in missing:
        _preallocate(work / shards[k], min(per, n_items - k * per) * width)
    if missing:
        cut = plans.cut_items(placed, per).where(F.col("shard").isin(missing) if len(missing) < len(shards) else F.lit(True))
        split = config.split

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in portions(whole, pc.list_value_length(whole.column(2)).to_numpy(), ITEMS_AT_ONCE):
                    lists = b.column(2)
                    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]) * width
                    raw = lists.flatten().to_numpy().astype(f"<u{width}").tobytes()
                    raws = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([f"{split}-{k:05d}.bin" for k in b.column(0).to_pylist()]), pa.array((b.column(1).to_numpy() % per) * width), raws], ["file", "at", "bytes"])

        with small_batches(spark):
            _put(cut.select(F.col("shard").cast("long").alias("shard"), "lo", "part").mapInArrow(pack, "file string, at long, bytes binary"), str(work))
        hashes = hash_files(spark, [str(work / shards[k]) for k in missing])
        for k in missing:
            n = min(per, n_items - k * per)
            done[shards[k]] = {"name": shards[k], "n_items": n, "n_bytes": n * width, "sha256": hashes[str(work / shards[k])]}
            atomic_json(work / "done" / f"{shards[k]}.json", done[shards[k]])

    _side_files(placed, coded, work, config.split, n_items, n_docs)
    crosses = F.floor(F.col("start") / per) != F.floor((F.col("end") - 1) / per)
    n_split = placed.where(crosses).count()
    stats = {"n_input": n_input, "n_docs": n_docs, "n_skipped": n_input - n_docs, "n_items": n_items, "n_shards": len(shards), "n_split_docs": n_split}
    issues = _issues(placed, coded, per, biggest, n_ids)
    entry = {"created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "n_items": n_items, "n_docs": n_docs, "n_skipped": stats["n_skipped"], "has_split_docs": bool(n_split), "shards": [done[s] for s in shards]}
    meta = old or {"schema_version": SCHEMA_VERSION, "modality": "text", "packing": "stream", "dtype": dtype, "item_shape": [], "byteorder": "little", "vocab_size": tok.vocab_size, "tokenizer_id": None, "tokenizer_hash": tok.fingerprint(), "eos_id": tok.eos_id, "bos_id": tok.bos_id, "splits": {}}
    meta["splits"] = {s: ({**meta["splits"], config.split: entry})[s] for s in SPLITS if s in {**meta["splits"], config.split: entry}}
    _publish(work, home, meta, tok, config.split)
    for used in (coded, placed):
        discard(used)
    warned = any(level == "warning" for _, level, _, _ in issues)
    return WriteResult("complete_with_issues" if warned else "complete", stats, issues, len(shards) - len(missing) if resumed else 0)


def _start(work: Path, plan: dict) -> bool:
    """Begin a write, or go on with one of the same settings and inputs. True if one goes on."""
    at = work / "plan.json"
    if at.is_file():
        was = json.loads(at.read_text())
        for key, code, what in (("config", "R205", "settings"), ("tokenizer", "R205", "tokenizer"), ("dtype", "R205", "item type"), ("input", "R203", "inputs or their order")):
            if was[key] != plan[key]:
                raise EngineError(code, f"the interrupted write in {work} has other {what}", fix="finish it as it began, or clean_source() first")
        return True
    shutil.rmtree(work, ignore_errors=True)
    (work / "done").mkdir(parents=True)
    atomic_json(at, plan)
    return False


def _guard(coded: DataFrame, policy: ErrorPolicy) -> None:
    """The policy: the first bad document raises, or too great a share of the inputs so far does."""
    bad = coded.where("code is not null")
    if policy.on_data_error == "raise":
        first = bad.orderBy("input_index").select("input_index", "code", "reason").limit(1).collect()
        if first:
            raise EngineError(first[0]["code"], f"document {first[0]['input_index']} can't be used", first[0]["reason"])
        return
    if bad.limit(1).count():
        run = running(coded.select("input_index", F.col("code").isNotNull().cast("int").alias("bad")), "input_index", F.col("bad"), "n_bad")
        so_far = F.col("input_index") + 1
        hit = run.where((so_far >= policy.min_docs_for_ratio) & (F.col("n_bad") / so_far > policy.max_skip_ratio)).agg(F.min("input_index")).first()[0]
        if hit is not None:
            raise EngineError("K204", f"at document {hit} more than {policy.max_skip_ratio:g} of the inputs were skipped", fix="mend the inputs, or allow more")


def _issues(placed: DataFrame, coded: DataFrame, per: int, biggest: int, n_ids: int) -> list[tuple[str, str, str, int]]:
    """By code: level, first message, count. Warnings first."""
    out = []
    for r in coded.where("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.min_by("reason", "input_index").alias("m")).orderBy("code").collect():
        out.append((r["code"], "warning", r["m"], r["n"]))
    if n_ids:
        n, example = placed.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1), F.min("id")).first()
        if n:
            out.append(("D205", "warning", f"ids that are there before, such as {example}", n))
    if biggest > per:
        out.append(("S201", "info", "documents longer than a shard", placed.where(F.col("n_items") > per).count()))
    large = placed.where((F.col("n_items") <= per) & (F.col("n_items") * 20 > per)).count()
    if large:
        out.append(("S202", "info", "documents over a twentieth of a shard", large))
    return out


def _side_files(placed: DataFrame, coded: DataFrame, work: Path, split: str, n_items: int, n_docs: int) -> None:
    starts = placed.select("doc_index", "start").unionByName(placed.sparkSession.createDataFrame([(n_docs, n_items)], "doc_index long, start long"))
    _column_file(starts, "doc_index", "start", f"{split}-offsets.npy", work, n_docs + 1)

    def lines(kind: str):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if kind == "ids":
                    made = [json.dumps({"id": x}, ensure_ascii=False) for x in b.column(1).to_pylist()]
                else:
                    made = [json.dumps(dict(zip(("input_index", "id", "code", "reason"), x)), ensure_ascii=False) for x in zip(*(c.to_pylist() for c in b.columns))]
                raw = [f"{x}\n".encode() for x in made]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["i", "size", "bytes"])

        return rows

    for kind, source in (("ids", placed.select("doc_index", "id")), ("skipped", coded.where("code is not null").select("input_index", "id", "code", "reason"))):
        made = running(source.mapInArrow(lines(kind), "i long, size long, bytes binary"), "i", F.col("size"), "end")
        made = materialize(made.withColumn("at", F.col("end") - F.col("size")), kind)
        total = made.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        name = f"{split}-{kind}.jsonl"
        (work / name).write_bytes(b"")
        _preallocate(work / name, total)
        _put(made.select(F.lit(name).alias("file"), "at", "bytes"), str(work))
        if kind == "ids":
            index = made.select("i", "at").unionByName(made.sparkSession.createDataFrame([(n_docs, total)], "i long, at long"))
            _column_file(index, "i", "at", f"{split}-ids.npy", work, n_docs + 1)


def _publish(work: Path, home: Path, meta: dict, tok: HubTokenizer, split: str) -> None:
    """Take over the files of other splits, write the metadata, and put the folder in place of the old one."""
    if home.is_dir():
        for p in home.iterdir():
            if p.is_file() and p.name != "meta.json" and not p.name.startswith(f"{split}-") and not (work / p.name).exists():
                os.link(p, work / p.name)
    (work / "tokenizer").mkdir(exist_ok=True)
    (work / "tokenizer" / "tokenizer.json").write_text(tok.text(), encoding="utf-8")
    for k in meta["splits"].values():
        for s in k["shards"]:
            if os.path.getsize(work / s["name"]) != s["n_bytes"]:
                raise EngineError("X101", f"{s['name']} has a wrong size")
    atomic_json(work / "meta.json", meta)
    shutil.rmtree(work / "done")
    (work / "plan.json").unlink()
    if home.is_dir():
        aside = Path(f"{home}.old-{os.getpid()}")
        os.rename(home, aside)
        os.rename(work, home)
        shutil.rmtree(aside)
    else:
        os.rename(work, home)
