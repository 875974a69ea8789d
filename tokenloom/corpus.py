"""A stored corpus: documents with their place in the stream, and the stream in chunks.

It is encoded and written once; every read goes to the stored tables. `chunks` is ordered by chunk number in
blocks, so filters on it leave out most row groups; many reads need the documents alone, so it may be left to its first use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import plans
from .storage import discard, free_name, materialize, running_sums, small_batches

CHUNK = 1000


@dataclass
class Corpus:
    """docs: the columns of the input without its text, tokens, n_pieces, n_items, start, end and doc_index.
    chunks: chunk, lo, tokens. vocab: piece, n, token. size: items of a chunk."""

    docs: DataFrame
    vocab: DataFrame
    n_items: int
    n_docs: int
    size: int = CHUNK

    @cached_property
    def chunks(self) -> DataFrame:
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        span = max(1, -(-self.n_items // self.size) // (4 * parts))
        cut = plans.chunks(self.docs.select("start", "end", plans.assembled().alias("items")), self.size, span=span)
        return materialize(cut.sortWithinPartitions("chunk"), "chunks")

    def placed(self) -> DataFrame:
        return self.docs.drop("tokens")

    def items(self) -> DataFrame:
        """doc_id, position, token of every item."""
        return plans.stream(self.docs.withColumn("items", plans.assembled()))


def write_corpus(docs: DataFrame, text: str = "text", order: str = "doc_id", size: int = CHUNK, cut: bool = True) -> Corpus:
    """Encode docs (order, text, ...) with a vocabulary of their own and store them. Order may hold nulls
    (they come first) and ties (ordered by a hash of the row); a null text has no tokens. Without cut the chunks
    are written when they are first read."""
    spark = docs.sparkSession
    row, tie = (free_name([*docs.columns, "tokens"], n) for n in ("row", "tie"))
    vocab = materialize(plans.vocabulary(docs, text), "vocabulary")
    with small_batches(spark):
        first, rest, gaps = plans.frequent_tokens(docs.withColumn(tie, F.xxhash64(*docs.columns)), vocab, text=text, with_text=False)
        coded = materialize(first.withColumn(row, F.monotonically_increasing_id()), "encoded")
        # places are worked out without the tokens, which are then moved once
        sized = coded.select(row, order, tie, F.size("tokens").cast("long").alias("n_pieces")).withColumn("n_items", F.col("n_pieces") + 1)
        placed = running_sums(sized, [order, tie], {"end": F.col("n_items"), "doc_index": F.lit(1)}).drop(order, tie)
        placed = placed.withColumns({"start": F.col("end") - F.col("n_items"), "doc_index": F.col("doc_index") - 1})
        placed = materialize(placed.select(row, "n_pieces", "n_items", "end", "start", "doc_index"), "places")
        met = coded.drop(tie, gaps).join(placed, row)
        if rest is not None:
            met = plans.filled(met.join(plans.rare_tokens(coded, rest, gaps, row), row, "left"), gaps, "tokens")
        stored = materialize(met.drop(row), "docs")
        discard(coded)
    n_items, n_docs = placed.agg(F.coalesce(F.max("end"), F.lit(0)), F.count("*")).first()
    out = Corpus(stored, vocab, n_items, n_docs, size)
    if cut:
        out.chunks
    return out
