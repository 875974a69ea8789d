"""Packed sources: each file compressed by itself beside a manifest, or all of it in one uncompressed tar.

Files are compressed, checked and restored by tasks. A pack is believed only as far as its hashes go: names are
confined, sizes bound decompression, and the restored source must agree with its own metadata.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
from collections import Counter
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..sinks import atomic_json
from .inspect import inspect_source, verify_report, verify_source
from .source import read_meta

MANIFEST, SUFFIX = "manifest.json", ".tlpack"
METHODS = ("zstd", "lzma", "none")
_STEP = 1 << 20


def safe_name(name: str) -> str:
    """A plain relative path, or an error: nothing absolute, no parent, no drive, no empty part."""
    parts = name.split("/")
    if not name or "\\" in name or "\0" in name or ":" in parts[0] or any(p in ("", ".", "..") for p in parts):
        raise EngineError("P101", f"{name!r} is no plain relative path")
    return name


def inside(home: Path, name: str) -> Path:
    """home/name, which no link leads out of home."""
    at = home / safe_name(name)
    if not at.resolve().is_relative_to(home.resolve()):
        raise EngineError("P101", f"{name!r} leads out of {home}")
    return at


def _writer(method: str, level: int, f):
    if method == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).stream_writer(f, closefd=False)
    if method == "lzma":
        import lzma

        return lzma.LZMAFile(f, "wb", preset=level)
    return None


def _reader(method: str, f):
    if method == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(f)
    if method == "lzma":
        import lzma

        return lzma.LZMAFile(f)
    return f


def _compress(source: Path, target: Path, method: str, level: int) -> tuple[int, str, int, str]:
    """Sizes and hashes before and after."""
    whole, n = hashlib.sha256(), 0
    temporary = target.with_name(f".{target.name}.{os.getpid()}")
    with open(source, "rb") as a, open(temporary, "wb") as b:
        w = _writer(method, level, b)
        while part := a.read(_STEP):
            whole.update(part)
            n += len(part)
            (w or b).write(part)
        if w:
            w.close()
    os.replace(temporary, target)
    with open(target, "rb") as f:
        return n, whole.hexdigest(), target.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest()


def _restore(source: Path, target: Path, method: str, n: int, want: str, packed: int, packed_want: str) -> str | None:
    """Restore a file; what is wrong, if anything. Never writes more than n bytes."""
    if not source.is_file():
        return "it is missing"
    if source.stat().st_size != packed:
        return f"{source.stat().st_size} bytes instead of {packed}"
    with open(source, "rb") as f:
        if hashlib.file_digest(f, "sha256").hexdigest() != packed_want:
            return "its packed bytes have changed"
    whole, left = hashlib.sha256(), n
    temporary = target.with_name(f".{target.name}.{os.getpid()}")
    try:
        with open(source, "rb") as a, open(temporary, "wb") as b:
            r = _reader(method, a)
            while part := r.read(min(_STEP, left + 1)):
                left -= len(part)
                if left < 0:
                    return f"it holds more than {n} bytes"
                whole.update(part)
                b.write(part)
        if left or whole.hexdigest() != want:
            return "its bytes have changed"
        os.replace(temporary, target)
    except Exception as e:  # noqa: BLE001
        return f"it can't be unpacked: {type(e).__name__}"
    finally:
        temporary.unlink(missing_ok=True)
    return None


def _each(spark: SparkSession, rows: list[tuple], schema: str, one, out: str) -> list:
    """one(row) for every row, a task for each file."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.string()) for v in one(*x)], names)

    df = spark.createDataFrame(rows, schema)
    return df.repartition(min(len(rows), 8 * spark.sparkContext.defaultParallelism), df.columns[0]).mapInArrow(run, out).collect()


def pack_source(spark: SparkSession, path: str | Path, target: str | Path, method: str = "zstd", level: int = 3, tar: bool = False) -> dict:
    """Pack a complete source into target (a folder, or with tar one file whose bytes depend on the source alone)."""
    home, target = Path(path), Path(target)
    if method not in METHODS:
        raise EngineError("C312", f"there is no method {method!r}", fix=f"use {', '.join(METHODS)}")
    if target.exists():
        raise EngineError("P102", f"{target} exists")
    if inspect_source(home)["state"] != "complete" or not verify_report(verify_source(spark, home))["ok"]:
        raise EngineError("P103", f"{home} is not complete and intact", fix="see verify_source()")
    folder = Path(f"{target}.partial")
    shutil.rmtree(folder, ignore_errors=True)
    names = sorted(PurePosixPath(p.relative_to(home)).as_posix() for p in home.rglob("*") if p.is_file())
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)

    def one(name: str) -> tuple:
        return name, *_compress(home / name, folder / name, method, level)

    got = _each(spark, [(n,) for n in names], "name string", one, "name string, n long, sha256 string, packed long, packed_sha256 string")
    files = sorted((r.asDict() for r in got), key=lambda r: r["name"])
    atomic_json(folder / MANIFEST, {"pack_version": 1, "method": method, "files": files})
    if tar:
        top = f"{home.name}{SUFFIX}"
        with tarfile.open(f"{target}.writing", "w", format=tarfile.PAX_FORMAT) as t:
            for n in [MANIFEST, *names]:
                info = tarfile.TarInfo(f"{top}/{n}")
                info.size, info.mode = (folder / n).stat().st_size, 0o644
                with open(folder / n, "rb") as f:
                    t.addfile(info, f)
        os.replace(f"{target}.writing", target)
        shutil.rmtree(folder)
    else:
        os.rename(folder, target)
    return {"files": len(files), "n_bytes": sum(f["n"] for f in files), "packed": sum(f["packed"] for f in files)}


def tar_members(path: Path) -> dict[str, tarfile.TarInfo]:
    """Members of a packed tar by name: one top folder, plain files and folders, no name twice."""
    out: dict[str, tarfile.TarInfo] = {}
    try:
        with tarfile.open(path, "r:") as t:
            for m in t:
                name = m.name.rstrip("/")
                safe_name(name)
                if not (m.isreg() or m.isdir()) or m.issparse():
                    raise EngineError("P104", f"{name} is neither a file nor a folder")
                if name in out:
                    raise EngineError("P104", f"{name} is there twice")
                out[name] = m
    except tarfile.TarError as e:
        raise EngineError("P104", f"{path} is no uncompressed tar", str(e)) from None
    tops = {n.split("/")[0] for n in out}
    if len(tops) != 1 or not next(iter(tops)).endswith(SUFFIX):
        raise EngineError("P104", f"{path} must hold one folder named *{SUFFIX}")
    return {n.split("/", 1)[1]: m for n, m in out.items() if "/" in n and m.isreg()}


def read_manifest(folder: Path) -> dict:
    at = folder / MANIFEST
    if not at.is_file():
        raise EngineError("P105", f"{folder} has no manifest")
    m = json.loads(at.read_text(encoding="utf-8"))
    if m.get("pack_version") != 1 or m.get("method") not in METHODS:
        raise EngineError("P105", f"{at} is of another version or method")
    twice = [n for n, k in Counter(f["name"] for f in m["files"]).items() if k > 1]
    if twice:
        raise EngineError("P105", f"{at} names {twice[0]} twice")
    for f in m["files"]:
        safe_name(f["name"])
    return m


def unpack_source(spark: SparkSession, packed: str | Path, target: str | Path) -> dict:
    """Restore a pack as the source target; all or nothing."""
    packed, target = Path(packed), Path(target)
    if target.exists():
        raise EngineError("P102", f"{target} exists")
    work, folder = Path(f"{target}.partial"), packed
    shutil.rmtree(work, ignore_errors=True)
    work.mkdir(parents=True)
    try:
        if packed.is_file():
            folder = Path(f"{target}.rm-{os.getpid()}")
            members = tar_members(packed)
            with tarfile.open(packed, "r:") as t:
                for name, m in members.items():
                    at = folder / name
                    at.parent.mkdir(parents=True, exist_ok=True)
                    with open(at, "wb") as f:
                        shutil.copyfileobj(t.extractfile(m), f)
        m = read_manifest(folder)
        rows = []
        for f in m["files"]:
            inside(work, f["name"]).parent.mkdir(parents=True, exist_ok=True)
            rows.append((f["name"], f["n"], f["sha256"], f["packed"], f["packed_sha256"]))
        method = m["method"]

        def one(name: str, n: int, sha: str, size: int, packed_sha: str) -> tuple:
            return name, _restore(inside(folder, name), inside(work, name), method, n, sha, size, packed_sha)

        bad = [r for r in _each(spark, rows, "name string, n long, sha256 string, packed long, packed_sha256 string", one, "name string, problem string") if r["problem"]]
        if bad:
            raise EngineError("P106", f"{bad[0]['name']}: {bad[0]['problem']}")
        of = {f["name"]: f["sha256"] for f in m["files"]}
        for s in read_meta(work)["splits"].values():
            for x in s["shards"]:
                if of.get(x["name"]) != x["sha256"]:
                    raise EngineError("P107", f"{x['name']} is not the shard that the metadata names")
        os.rename(work, target)
    finally:
        shutil.rmtree(work, ignore_errors=True)
        if folder != packed:
            shutil.rmtree(folder, ignore_errors=True)
    return {"files": len(m["files"]), "n_bytes": sum(f["n"] for f in m["files"])}


def manifest_files(spark: SparkSession, folder: str | Path) -> DataFrame:
    """name, n, packed, ratio of the files of a packed folder."""
    rows = [(f["name"], f["n"], f["packed"]) for f in read_manifest(Path(folder))["files"]]
    return spark.createDataFrame(rows, "name string, n long, packed long").withColumn("ratio", F.col("packed") / F.greatest(F.lit(1), F.col("n")))
