"""Column functions: pieces of text, item widths, names, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNK, EOS, BOS, FIRST_WORD = 0, 1, 2, 3
PIECE = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
SOURCE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"


def pieces(text: str | Column) -> Column:
    """Runs of letters, marks and digits, and runs of signs; nothing of white space. Null gives none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(t, F.lit(PIECE), 0), F.array().cast("array<string>"))


def item_type(vocab_size: Column) -> Column:
    """The narrowest unsigned type for ids below vocab_size; null outside 1 .. 2**32."""
    v = vocab_size
    return (
        F.when((v < 1) | (v > 1 << 32), F.lit(None).cast("string")).when(v <= 1 << 8, "uint8").when(v <= 1 << 16, "uint16").otherwise("uint32")
    )


def item_bytes(vocab_size: Column) -> Column:
    return F.when(vocab_size <= 1 << 8, 1).when(vocab_size <= 1 << 16, 2).otherwise(4)


def valid_source_name(name: Column) -> Column:
    return name.rlike(SOURCE_NAME) & ~name.endswith(".partial")


def split_order(split: Column) -> Column:
    """train, valid, test in this order; null for anything else."""
    return F.nullif(F.array_position(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), split), F.lit(0).cast("long"))


def format_bytes(n: Column) -> Column:
    """12 B, 3.4 KiB, 5.6 MiB, 7.8 GiB: one decimal from KiB on, rounded half up in integers."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        tenths = F.floor((n.cast("long") * 10 + 1024**power // 2) / 1024**power)
        out = F.when(n >= 1024**power, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def id_line(id_: Column) -> Column:
    """The line of a document id in the id file, null included."""
    return F.concat(F.lit('{"id": '), F.coalesce(F.to_json(F.array(id_)), F.lit("[null]")).substr(F.lit(2), F.length(F.coalesce(F.to_json(F.array(id_)), F.lit("[null]"))) - 2), F.lit("}\n"))
