"""Lookups and windows. A window is joined to chunks by chunk number (an equi-join), never by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(wanted: DataFrame, chunked: DataFrame, size: int) -> DataFrame:
    """wanted (window, start, length) -> window, start, tokens in order; a window may cross chunks.
    Length 0 gives an empty array; positions past the end are absent."""
    end = F.col("start") + F.col("length")
    parts = wanted.where("length > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
    lo = F.greatest(F.col("start"), F.col("lo"))
    hi = F.least(end, F.col("lo") + size)
    met = parts.join(chunked, "chunk").select("window", lo.alias("at"), F.slice("tokens", (lo - F.col("lo") + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int")).alias("part"))
    whole = met.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x")).select("window", F.flatten("x.part").alias("tokens"))
    return wanted.join(whole, "window", "left").select("window", "start", F.coalesce("tokens", F.array().cast("array<bigint>")).alias("tokens"))


def items_at(wanted: DataFrame, chunked: DataFrame, size: int, total: int) -> DataFrame:
    """wanted (index) -> index, token; a negative index counts from the end."""
    at = F.when(F.col("index") < 0, F.col("index") + total).otherwise(F.col("index"))
    w = wanted.withColumn("at", at).withColumn("chunk", F.floor(F.col("at") / size))
    return w.join(chunked, "chunk").select("index", F.try_element_at("tokens", (F.col("at") - F.col("lo") + 1).cast("int")).alias("token"))


def sliced(chunked: DataFrame, start: int | None, stop: int | None, step: int, total: int, size: int) -> DataFrame:
    """Items of a Python slice: rank (order of the result), position, token. Chunks outside of it aren't read."""
    a, b, s = slice(start, stop, step).indices(total)
    lo, hi = (a, b - 1) if s > 0 else (b + 1, a)
    near = chunked.where(F.col("chunk").between(lo // size, hi // size) if lo <= hi else F.lit(False))
    items = near.select("lo", F.posexplode("tokens").alias("pos", "token")).select((F.col("lo") + F.col("pos")).alias("position"), "token")
    rank = (F.col("position") - a) / s
    return items.where(F.col("position").between(lo, hi) & ((F.col("position") - a) % abs(s) == 0)).select(rank.cast("long").alias("rank"), "position", "token")


def documents_by_id(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents of the ids in wanted (id); null ids and ids that aren't there give none."""
    return docs.join(wanted.where("id is not null").distinct(), "id")


def document_at(positions: DataFrame, placed: DataFrame, span: int) -> DataFrame:
    """positions (position) -> position, doc_id: the document that holds it, by blocks of `span` items."""
    covered = placed.where("end > start").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))))
    p = positions.withColumn("block", F.floor(F.col("position") / span))
    return p.join(covered, "block").where("start <= position and position < end").select("position", "doc_id")


def grid(total: int | F.Column, length: int, stride: int) -> F.Column:
    """Starts of the windows of a grid; the tail that fills no window is dropped."""
    n = F.lit(total) if isinstance(total, int) else total
    return F.when(n >= length, F.sequence(F.lit(0).cast("long"), n - length, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def next_token_pairs(w: DataFrame) -> DataFrame:
    """window, x (all but the last token), y (all but the first)."""
    n = F.greatest(F.lit(0), F.size("tokens") - 1)
    return w.select("window", F.slice("tokens", F.lit(1), n).alias("x"), F.slice("tokens", F.lit(2), n).alias("y"))
