"""Inspection, verification and maintenance of written sources."""

from __future__ import annotations

import importlib.util
import json
import os
import shutil
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..sinks import NAME, SPLITS, file_sha256
from .source import index_problem, read_meta

STEP = 1 << 20  # values of an index that a task checks
TEXT_STEP = 1 << 20  # bytes of the lines that it holds


def source_names(root: str | Path) -> list[str]:
    """Sources of a folder, finished or begun, sorted."""
    found = {p.name.removesuffix(".partial") for p in Path(root).iterdir() if p.is_dir() and ((p / "meta.json").is_file() or p.name.endswith(".partial"))}
    return sorted(n for n in found if NAME.fullmatch(n))


def _sizes(home: Path, m: dict) -> list[tuple[str, str, str, str]]:
    """Problems that sizes and headers show: split, file, code, what."""
    out = []
    for split, s in m["splits"].items():
        for x in s["shards"]:
            at = home / x["name"]
            if not at.is_file():
                out.append((split, x["name"], "I101", "it is missing"))
            elif at.stat().st_size != x["n_bytes"]:
                out.append((split, x["name"], "I101", f"{at.stat().st_size} bytes instead of {x['n_bytes']}"))
        lines = home / f"{split}-ids.jsonl"
        for kind, last in (("offsets", s["n_items"]), ("ids", lines.stat().st_size if lines.is_file() else -1)):
            problem = index_problem(home / f"{split}-{kind}.npy", s["n_docs"] + 1, last)
            if problem:
                out.append((split, f"{split}-{kind}.npy", "I102", problem))
    return out


def inspect_source(path: str | Path) -> dict:
    """State (complete, partial, corrupt, unsupported), counters by split, problems and issues. Reads no shard."""
    home = Path(path)
    partial = Path(f"{home}.partial")
    begun = {"resumable": (partial / "plan.json").is_file(), "shards": sorted(p.name.removesuffix(".json") for p in (partial / "done").glob("*.json"))} if partial.is_dir() else None
    out = {"name": home.name, "state": "complete", "splits": {}, "n_items": 0, "n_docs": 0, "tokenizer_hash": None, "problems": [], "issues": [], "partial": begun}
    if not (home / "meta.json").is_file():
        if begun is None:
            raise EngineError("F101", f"{home} is no source")
        return out | {"state": "partial"}
    try:
        m = read_meta(home)
    except EngineError as e:
        return out | {"state": "unsupported" if e.code == "F105" else "corrupt", "problems": [(None, "meta.json", e.code, e.what)]}
    for split in (s for s in SPLITS if s in m["splits"]):
        s = m["splits"][split]
        out["splits"][split] = {k: s[k] for k in ("created_at", "n_items", "n_docs", "n_skipped", "has_split_docs")} | {"n_shards": len(s["shards"])}
        out["n_items"] += s["n_items"]
        out["n_docs"] += s["n_docs"]
        if s["n_skipped"]:
            out["issues"].append(("D200", "warning", f"{split}: documents were skipped", s["n_skipped"]))
        if s["has_split_docs"]:
            out["issues"].append(("S200", "info", f"{split}: some documents cross a border of shards", 1))
    if begun:
        out["issues"].insert(0, ("R200", "warning", "a write has begun and isn't finished", 1))
    out["tokenizer_hash"] = m["tokenizer_hash"]
    out["problems"] = _sizes(home, m)
    return out | {"state": "corrupt" if out["problems"] else "complete"}


def inspect_corpus(root: str | Path) -> dict:
    """All sources of a folder, the normalised mixture, and whether it is ready to train on."""
    found = [inspect_source(Path(root) / n) for n in source_names(root)]
    hashes = {s["tokenizer_hash"] for s in found if s["tokenizer_hash"]}
    problems = [("K208", "the sources have different tokenizers")] if len(hashes) > 1 else []
    mix: dict[str, float] = {}
    at = Path(root) / "mix.json"
    if at.is_file():
        from .mixture import checked_weights

        try:
            weights = checked_weights(json.loads(at.read_text()))
            total = sum(weights.values())
            mix = {k: w / total for k, w in weights.items() if w > 0}
            problems += [("F110", f"mix.json names {k}, which isn't there") for k in mix if k not in {s["name"] for s in found}]
        except (ValueError, EngineError) as e:
            problems.append(("F109", str(e)))
    ready = bool(found) and not problems and all(s["state"] == "complete" for s in found)
    return {"sources": found, "n_items": sum(s["n_items"] for s in found), "n_docs": sum(s["n_docs"] for s in found), "mix": mix, "problems": problems, "ready": ready}


def verify_source(spark: SparkSession, path: str | Path) -> DataFrame:
    """split, file, status (ok, missing, wrong_size, wrong_hash, wrong_values), n_bytes, problem: of every file. Shards are
    hashed and index values checked by tasks; damaged data is reported, never raised."""
    home = Path(path)
    m = read_meta(home)
    tasks = []
    for split, s in m["splits"].items():
        tasks += [(split, x["name"], "shard", x["n_bytes"], x["sha256"], 0) for x in s["shards"]]
        for kind in ("offsets", "ids"):
            n = s["n_docs"] + 1
            last = s["n_items"] if kind == "offsets" else -1
            tasks += [(split, f"{split}-{kind}.npy", kind, n, str(last), lo) for lo in range(0, n, STEP)]
        tasks.append((split, f"{split}-skipped.jsonl", "skipped", s["n_skipped"], "", 0))

    def one(split: str, name: str, kind: str, n: int, want: str, lo: int) -> tuple[str, int, str | None]:
        at = home / name
        if not at.is_file():
            return "missing", 0, "it is missing"
        size = at.stat().st_size
        if kind == "shard":
            if size != n:
                return "wrong_size", size, f"{size} bytes instead of {n}"
            return ("ok", size, None) if file_sha256(str(at)) == want else ("wrong_hash", size, "its bytes have changed")
        if kind == "skipped":
            with open(at, "rb") as f:
                lines = sum(1 for _ in f)
            return ("ok", size, None) if lines == n else ("wrong_values", size, f"{lines} lines instead of {n}")
        text = home / f"{split}-ids.jsonl"
        last = int(want) if kind == "offsets" else text.stat().st_size if text.is_file() else -1
        problem = index_problem(at, n, last)
        if problem:
            return "wrong_size", size, problem
        v = np.array(np.load(at, mmap_mode="r")[lo : lo + STEP + 1])  # one more: parts overlap
        down = np.flatnonzero(np.diff(v) < (1 if kind == "ids" else 0))
        if len(down):
            return "wrong_values", size, f"value {lo + int(down[0]) + 1} is below the one before"
        if kind == "ids" and len(v) > 1:
            if v[0] < 0 or v[-1] > last:
                return "wrong_values", size, f"values {lo} to {lo + len(v) - 1} reach outside of the lines"
            ends = v[1:] - 1
            with open(text, "rb") as f:
                f.seek(int(v[0]))
                for at in range(int(v[0]), int(v[-1]), TEXT_STEP):
                    raw = np.frombuffer(f.read(min(TEXT_STEP, int(v[-1]) - at)), np.uint8)
                    mine = ends[slice(*np.searchsorted(ends, (at, at + len(raw))))]
                    if (raw[mine - at] != 10).any():
                        return "wrong_values", size, "a line doesn't end where the next one starts"
        return "ok", min(size, 8 * len(v)), None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns)):
                status, size, problem = one(*x)
                yield pa.RecordBatch.from_arrays([pa.array([x[0]]), pa.array([x[1]]), pa.array([status]), pa.array([size], pa.int64()), pa.array([problem], pa.string())], ["split", "file", "status", "n_bytes", "problem"])

    listed = spark.createDataFrame(tasks, "split string, file string, kind string, n long, want string, lo long")
    listed = listed.repartition(min(len(tasks), 8 * spark.sparkContext.defaultParallelism), "file", "lo")
    checked = listed.mapInArrow(rows, "split string, file string, status string, n_bytes long, problem string")
    worst = F.max(F.struct((F.col("status") != "ok").alias("bad"), "status", "problem"))
    return checked.groupBy("split", "file").agg(worst.alias("w"), F.sum("n_bytes").alias("n_bytes")).select("split", "file", "w.status", "n_bytes", "w.problem")


def verify_report(files: DataFrame) -> dict:
    """ok, files, bytes checked and the bad files, of verify_source()."""
    n, size = files.agg(F.count("*"), F.sum("n_bytes")).first()
    bad = [r.asDict() for r in files.where("status <> 'ok'").orderBy("file").collect()]
    return {"ok": not bad, "n_files": n, "n_bytes": size or 0, "bad": bad}


def clean_source(path: str | Path) -> list[str]:
    """Remove what unfinished writes and removals have left beside a source."""
    home = Path(path)
    gone = [p for p in home.parent.glob(f"{home.name}.*") if p.name == f"{home.name}.partial" or p.name.startswith((f"{home.name}.old-", f"{home.name}.rm-"))]
    for p in gone:
        shutil.rmtree(p)
    return sorted(p.name for p in gone)


def remove_source(path: str | Path) -> None:
    """Remove a source; it is renamed first, so no half of it is ever seen."""
    home = Path(path)
    if home.is_symlink() or not (home / "meta.json").is_file():
        raise EngineError("C310", f"{home} is no source of its own")
    aside = Path(f"{home}.rm-{os.getpid()}")
    os.rename(home, aside)
    shutil.rmtree(aside)


def doctor() -> dict:
    """Versions and optional packages."""
    import pyspark

    return {"python": sys.version.split()[0], "spark": pyspark.__version__, "packages": {n: importlib.util.find_spec(n) is not None for n in ("tokenizers", "zstandard", "pyarrow", "numpy", "torch")}}
