"""Reading a written source: items, slices, windows and documents straight from the shard files.

Opening reads the metadata, the sizes of the files and two values of each index; nothing is read in full. Bulk reads
are tasks that map the shards they need, so a window costs what it holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, integer
from ..sinks import SCHEMA_VERSION, SPLITS
from ..storage import portions

ITEMS_AT_ONCE = 1 << 20  # of windows that a task hands on together
_ITEM = {"uint8": "<u1", "uint16": "<u2", "uint32": "<u4"}


def read_meta(home: Path) -> dict:
    """The metadata of a source, checked field by field and across fields. Unknown keys are ignored."""
    at = home / "meta.json"
    if not at.is_file():
        raise EngineError("F101", f"{home} is no source", "it has no meta.json")
    if at.stat().st_size > 16 << 20:
        raise EngineError("F102", f"{at} is too large")

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise EngineError("F103", f"{at} repeats a key")
        return dict(pairs)

    def refuse(value: str) -> float:
        raise EngineError("F103", f"{at} holds {value}")

    try:
        m = json.loads(at.read_text(encoding="utf-8"), object_pairs_hook=unique, parse_constant=refuse)
    except ValueError as e:
        raise EngineError("F103", f"{at} is not JSON", str(e)) from None
    version = m.get("schema_version") if isinstance(m, dict) else None
    if type(version) is not int or version < 1:
        raise EngineError("F104", f"{at} has no schema version")
    if version > SCHEMA_VERSION:
        raise EngineError("F105", f"{at} has schema {version}", f"this version reads up to {SCHEMA_VERSION}")
    for key, kind in (("dtype", str), ("vocab_size", int), ("tokenizer_hash", str), ("splits", dict)):
        if type(m.get(key)) is not kind:
            raise EngineError("F104", f"{at}: {key} is missing or no {kind.__name__}")
    if m["dtype"] not in _ITEM or not 1 <= m["vocab_size"] <= 1 << 8 * np.dtype(m["dtype"]).itemsize:
        raise EngineError("F104", f"{at}: {m['vocab_size']} ids in {m['dtype']}")
    if not m["splits"] or any(s not in SPLITS for s in m["splits"]):
        raise EngineError("F104", f"{at}: splits must be some of {', '.join(SPLITS)}")
    for key in ("eos_id", "bos_id"):
        if m.get(key) is not None and not (type(m[key]) is int and 0 <= m[key] < m["vocab_size"]):
            raise EngineError("F104", f"{at}: {key} is outside of the vocabulary")
    width = np.dtype(m["dtype"]).itemsize
    for name, s in m["splits"].items():
        for k, x in enumerate(s["shards"]):
            if x["name"] != f"{name}-{k:05d}.bin" or x["n_bytes"] != x["n_items"] * width:
                raise EngineError("F106", f"{at}: shard {x['name']} is out of order or has a wrong size")
        if sum(x["n_items"] for x in s["shards"]) != s["n_items"]:
            raise EngineError("F106", f"{at}: the shards of {name} don't add up to {s['n_items']} items")
    return m


@dataclass
class Source:
    """A split of a source, as read_source() opens it. It travels to tasks as its paths and numbers."""

    home: str
    split: str
    n_items: int
    n_docs: int
    dtype: str
    starts: list[int]
    names: list[str]
    tokenizer_hash: str

    def __len__(self) -> int:
        return self.n_items

    def read(self, start: int, length: int) -> np.ndarray:
        """Items start .. start + length, over shard borders."""
        out, end = [], start + length
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        while start < end:
            stop = min(end, self.starts[k + 1])
            if stop > start:
                part = np.memmap(f"{self.home}/{self.names[k]}", _ITEM[self.dtype], "r")
                out.append(part[start - self.starts[k] : stop - self.starts[k]])
            start, k = stop, k + 1
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)

    def window(self, start: int, length: int) -> np.ndarray:
        start, length = integer(start, "start", 0), integer(length, "length", 0)
        if start + length > self.n_items:
            raise EngineError("C304", f"a window of {length} items from {start} doesn't fit {self.n_items} items")
        return self.read(start, length)

    def __getitem__(self, at: int | slice) -> int | np.ndarray:
        if isinstance(at, slice):
            a, b, s = at.indices(self.n_items)
            if s == 1:
                return self.read(a, max(0, b - a))
            n = len(range(a, b, s))
            lo, hi = (a, a + (n - 1) * s) if s > 0 else (a + (n - 1) * s, a)
            got = self.read(lo, hi - lo + 1) if n else np.zeros(0, np.int64)
            return got[::s] if s > 0 else got[::-1][:: -s]
        i = integer(at, "index", -self.n_items, self.n_items - 1)
        return int(self.read(i % self.n_items, 1)[0])

    def doc(self, i: int) -> np.ndarray:
        """A document with its separators; a negative number counts from the end."""
        i = integer(i, "document", -self.n_docs, self.n_docs - 1) % self.n_docs
        a, b = np.load(f"{self.home}/{self.split}-offsets.npy", mmap_mode="r")[i : i + 2].tolist()
        return self.read(a, b - a)

    def id_of_doc(self, i: int) -> str | None:
        i = integer(i, "document", -self.n_docs, self.n_docs - 1) % self.n_docs
        a, b = np.load(f"{self.home}/{self.split}-ids.npy", mmap_mode="r")[i : i + 2].tolist()
        with open(f"{self.home}/{self.split}-ids.jsonl", "rb") as f:
            f.seek(a)
            return json.loads(f.read(b - a))["id"]

    def windows(self, wanted: DataFrame) -> DataFrame:
        """wanted (window, start, length) -> window, start, tokens. One that doesn't fit is an error."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x for whole in batches for x in portions(whole, np.maximum(whole.column(2).to_numpy(), 0), ITEMS_AT_ONCE)):
                got = [self.window(s, n) for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int64()))], ["window", "start", "tokens"])

        return wanted.select(*(F.col(c).cast("long").alias(c) for c in ("window", "start", "length"))).mapInArrow(rows, "window long, start long, tokens array<bigint>")

    def chunks(self, spark: SparkSession, size: int = 1 << 16) -> DataFrame:
        """chunk, lo, tokens: the whole stream, read in parallel."""
        last = self.n_items
        spans = spark.range(-(-last // size)).select(F.col("id").alias("window"), (F.col("id") * size).alias("start"), F.least(F.lit(size), F.lit(last) - F.col("id") * size).alias("length"))
        return self.windows(spans).select(F.col("window").alias("chunk"), F.col("start").alias("lo"), "tokens")

    def docs(self, spark: SparkSession, step: int = 1 << 14) -> DataFrame:
        """doc_index, id, start, end of every document."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            offsets = np.load(f"{self.home}/{self.split}-offsets.npy", mmap_mode="r")
            index = np.load(f"{self.home}/{self.split}-ids.npy", mmap_mode="r")
            for b in batches:
                for lo in b.column(0).to_pylist():
                    hi = min(lo + step, self.n_docs)
                    with open(f"{self.home}/{self.split}-ids.jsonl", "rb") as f:
                        f.seek(int(index[lo]))
                        ids = [json.loads(x)["id"] for x in f.read(int(index[hi] - index[lo])).splitlines()]
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo, hi), pa.int64()), pa.array(ids, pa.string()), pa.array(np.array(offsets[lo:hi])), pa.array(np.array(offsets[lo + 1 : hi + 1]))], ["doc_index", "id", "start", "end"])

        return spark.range(0, self.n_docs, step).mapInArrow(rows, "doc_index long, id string, start long, end long")

    def sample_windows(self, spark: SparkSession, n: int, block: int, rng: np.random.Generator) -> DataFrame:
        """n windows at random starts, the draws of rng.integers(0, n_items - block + 1, size=n)."""
        starts = draw_starts(self.n_items, n, block, rng)
        return self.windows(spark.createDataFrame(pa.table({"window": np.arange(len(starts)), "start": starts, "length": np.full(len(starts), block)})))

    def grid(self, spark: SparkSession, block: int, stride: int | None = None) -> DataFrame:
        """Windows every stride items; the tail that fills none is dropped."""
        block = integer(block, "block", 1)
        stride = block if stride is None else integer(stride, "stride", 1)
        if block > self.n_items:
            raise EngineError("C304", f"a window of {block} items doesn't fit {self.n_items} items")
        n = (self.n_items - block) // stride + 1
        return self.windows(spark.range(n).select(F.col("id").alias("window"), (F.col("id") * stride).alias("start"), F.lit(block).alias("length")))


def draw_starts(total: int, n: int, block: int, rng: object) -> np.ndarray:
    n, block = integer(n, "n", 0), integer(block, "block", 1)
    if not isinstance(rng, np.random.Generator):
        raise EngineError("C308", "rng must be a numpy Generator", fix="numpy.random.default_rng(seed)")
    if block > total:
        raise EngineError("C304", f"a window of {block} items doesn't fit {total} items")
    return rng.integers(0, total - block + 1, size=n)


def read_source(path: str | Path, split: str = "train") -> Source:
    """Open a split: every shard must be there with its size, the indexes with their ends."""
    home = Path(path)
    m = read_meta(home)
    if split not in m["splits"]:
        raise EngineError("C309", f"{home} has no split {split!r}", f"it has {', '.join(m['splits'])}")
    s = m["splits"][split]
    for x in s["shards"]:
        at = home / x["name"]
        if not at.is_file() or at.stat().st_size != x["n_bytes"]:
            raise EngineError("I101", f"{at} is missing or has a wrong size")
    for kind, last in (("offsets", s["n_items"]), ("ids", (home / f"{split}-ids.jsonl").stat().st_size if (home / f"{split}-ids.jsonl").is_file() else -1)):
        problem = index_problem(home / f"{split}-{kind}.npy", s["n_docs"] + 1, last)
        if problem:
            raise EngineError("I102", f"{home / f'{split}-{kind}.npy'}: {problem}")
    starts = np.concatenate([[0], np.cumsum([x["n_items"] for x in s["shards"]])]).astype(int).tolist()
    return Source(str(home), split, s["n_items"], s["n_docs"], m["dtype"], starts, [x["name"] for x in s["shards"]], m["tokenizer_hash"])


def index_problem(path: Path, length: int, last: int) -> str | None:
    """What is wrong with the header and the ends of an int64 index, if anything."""
    if not path.is_file():
        return "it is missing"
    try:
        a = np.load(path, mmap_mode="r", allow_pickle=False)
    except ValueError as e:
        return str(e)
    if a.dtype != np.dtype("<i8") or a.shape != (length,):
        return f"{a.dtype} {a.shape} instead of int64 ({length},)"
    return None if a[0] == 0 and a[-1] == last else f"it runs from {a[0]} to {a[-1]} instead of 0 to {last}"
