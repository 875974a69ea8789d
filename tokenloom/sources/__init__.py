"""Text inputs: documents (input_index, id, raw, unreadable) from folders of text and from JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..storage import materialize, numbered

SCHEMA = "input_index long, id string, raw binary, unreadable string"


def _files(root: str, pattern: str) -> list[tuple[str, str]]:
    """(relative posix path, path) of the files of root that match, by code points; root may be a file. The names are
    listed here, the bytes are read by tasks."""
    at = Path(root)
    if at.is_file():
        return [(at.name, str(at))]
    if not at.is_dir():
        raise EngineError("C311", f"{root} doesn't exist", fix="give a folder or a file")
    found = sorted((PurePosixPath(p.relative_to(at)).as_posix(), str(p)) for p in at.rglob(pattern) if p.is_file())
    if not found:
        raise EngineError("C311", f"no file in {root} matches {pattern}")
    return found


def _listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    names, paths = zip(*_files(root, pattern))
    table = pa.table({"no": pa.array(range(len(names)), pa.int64()), "name": list(names), "path": list(paths)})
    return spark.createDataFrame(table).repartition(min(len(names), 8 * spark.sparkContext.defaultParallelism), "no")


def txt_dir(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """A document per file, hidden ones included, in the order of their paths; the id is the relative path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, name, path in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([name]), pa.array([Path(path).read_bytes()], pa.binary()), pa.nulls(1, pa.string())], ["input_index", "id", "raw", "unreadable"])

    return _listing(spark, root, pattern).mapInArrow(rows, SCHEMA)


def _record(line: bytes, field: str) -> tuple[bytes | None, str | None]:
    """The text of a JSON line, or why there is none."""
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return None, "the line is not JSON"
    if not isinstance(value, dict):
        return None, "the line is not an object"
    if field not in value:
        return None, f"there is no field {field}"
    if not isinstance(value[field], str):
        return None, f"the field {field} is not a string"
    try:
        return value[field].encode(), None
    except UnicodeEncodeError:
        return value[field].encode("utf-8", "surrogatepass"), None  # refused later as invalid UTF-8


def jsonl(spark: SparkSession, root: str, field: str = "text", pattern: str = "*.jsonl") -> DataFrame:
    """A document per line, id `path:line` with lines numbered from 0. Blank lines keep their number and
    give no document; a line without the text gives an unreadable one. Lines end with a line feed alone.
    Files are read line by line, so a task holds one line and one batch."""
    if not isinstance(field, str) or not field:
        raise EngineError("C210", "field must be a name")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "line", "id", "raw", "unreadable"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for b in batches:
            for no, name, path in zip(*(c.to_pylist() for c in b.columns)):
                held: list[tuple] = []
                size = 0
                with open(path, "rb") as f:
                    for i, line in enumerate(f):
                        if not line.strip():
                            continue
                        raw, why = _record(line, field)
                        held.append((no, i, f"{name}:{i}", raw, why))
                        size += len(line)
                        if len(held) >= 1024 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    lines = _listing(spark, root, pattern).mapInArrow(rows, "file long, line long, id string, raw binary, unreadable string")
    return numbered(materialize(lines, "lines"), ["file", "line"], "input_index").select("input_index", "id", "raw", "unreadable")


def from_table(docs: DataFrame, order: str, text: str = "text", id: str | None = None, unreadable: str | None = None) -> DataFrame:
    """Documents of any table in the order of a column: text may be STRING or BINARY, ids all or none."""
    kind = docs.schema[text].dataType.simpleString()
    if kind not in ("string", "binary"):
        raise EngineError("K202", f"the text column is {kind}", "it must be STRING or BINARY")
    if id is not None and docs.schema[id].dataType.simpleString() != "string":
        raise EngineError("K203", "the id column must be STRING")
    none = F.lit(None).cast("string")
    d = docs.select(F.col(order).alias("o"), (F.col(id) if id else none).alias("id"), F.col(text).cast("binary").alias("raw"), (F.col(unreadable) if unreadable else none).alias("unreadable"))
    return numbered(d, "o", "input_index").select("input_index", "id", "raw", "unreadable")


def total_bytes(root: str, pattern: str) -> int:
    """Bytes of the files that an input reads, for progress."""
    return sum(Path(p).stat().st_size for _, p in _files(root, pattern))
