"""The token stream as plans: vocabulary, encoding, offsets, chunks, shards.

Order always comes from a column. Numbers and running sums are those of storage.running: range partitions and
the sums of whole partitions, so no task sorts a table. Tokens stay in one array per document; a
document is encoded where it is, against a vocabulary whose frequent part is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BOS, EOS, FIRST_WORD, UNK, pieces
from ..storage import free_name, materialize, numbered, portions, running

#: Entries and bytes of the part of a vocabulary that is broadcast; the rest is joined.
BROADCAST_PIECES, BROADCAST_BYTES = 1 << 18, 16 << 20
#: Pieces or tokens that a Python worker handles at a time.
AT_ONCE = 1 << 18


def piece_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos (from 0), piece."""
    return docs.select("doc_id", F.posexplode(pieces(text)).alias("pos", "piece"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """piece, n, token of all texts: ids by falling frequency, then piece. Counts are summed up before they are
    shuffled, and pieces are numbered by range partitions."""
    v = docs.select(F.explode(pieces(text)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    ranked = numbered(v.withColumn("falling", -F.col("n")), ["falling", "piece"], "token")
    return ranked.select("piece", "n", (F.col("token") + FIRST_WORD).alias("token"))


def _frequent(vocab: DataFrame, limit: int) -> tuple[int, pa.Table]:
    """The pieces and tokens below limit, or below a smaller one that BROADCAST_BYTES allows, and that limit."""
    head = vocab.where(F.col("token") < limit).select("piece", "token")
    room = head.agg(F.coalesce(F.sum(F.octet_length("piece") + 16), F.lit(0))).first()[0]
    if room > BROADCAST_BYTES:
        limit = FIRST_WORD + int((limit - FIRST_WORD) * BROADCAST_BYTES / room / 2)
        head = head.where(F.col("token") < limit)
    return limit, head.toArrow()


def _lists(sizes: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, vocab: DataFrame, cap: int | None = None, text: str = "text", out: str = "tokens", with_text: bool = True) -> DataFrame:
    """docs with `out`, an array of token ids; pieces that vocab (piece, token) doesn't have are UNK, and with a
    cap so are all but the cap most frequent ones. The text may be left out.

    The pieces of the least ids, as many as BROADCAST_PIECES and BROADCAST_BYTES allow, are broadcast and looked up in the
    document's own row. If there are more, occurrences of the others, which are rare ones, are joined.
    """
    found, rest, gaps = frequent_tokens(docs, vocab, cap, text, out, with_text)
    if rest is None:
        return found
    key = free_name(found.columns, "row")
    found = materialize(found.withColumn(key, F.monotonically_increasing_id()), "encoded")
    return filled(found.drop(gaps).join(rare_tokens(found, rest, gaps, key), key, "left"), gaps, out).drop(key)


def frequent_tokens(docs: DataFrame, vocab: DataFrame, cap: int | None = None, text: str = "text", out: str = "tokens", with_text: bool = True) -> tuple[DataFrame, DataFrame | None, str]:
    """The first half of encode(): docs with `out`, where pieces that aren't broadcast are -1, the rest of the
    vocabulary, and the name of the column with those pieces in their order. Without a rest there is no such column."""
    limit, known = _frequent(vocab, FIRST_WORD + (BROADCAST_PIECES if cap is None else min(cap, BROADCAST_PIECES)))
    rest = vocab.where(F.col("token") >= limit) if cap is None else vocab.where(F.col("token").between(limit, FIRST_WORD + cap - 1))
    more = not rest.isEmpty()
    shared = docs.sparkSession.sparkContext.broadcast((known["piece"].combine_chunks(), known["token"].to_numpy()))
    split = free_name([*docs.columns, out], "pieces")
    cut = docs.drop(out).withColumn(split, pieces(text))
    cut = cut if with_text else cut.drop(text)
    at = cut.columns.index(split)
    kept = cut.drop(split)
    names_out = [*kept.columns, *([split] if more else []), out]
    table: dict[str, dict] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "ids" not in table:
            names, ids = shared.value
            table["ids"] = dict(zip(names.to_pylist(), ids.tolist()))
        of = table["ids"]
        for whole in batches:
            for b in portions(whole, _sizes(whole.column(at)), AT_ONCE):
                size, words = _sizes(b.column(at)), b.column(at).flatten()
                coded = words.dictionary_encode()
                look = np.array([of.get(x, -1 if more else UNK) for x in coded.dictionary.to_pylist()], np.int64)
                flat = look[coded.indices.to_numpy()] if len(look) else np.zeros(0, np.int64)
                others = [c for i, c in enumerate(b.columns) if i != at]
                if more:
                    gap = flat < 0
                    ends = np.concatenate([[0], np.cumsum(gap)])[np.concatenate([[0], np.cumsum(size)])]
                    others.append(_lists(np.diff(ends), words.filter(pa.array(gap))))
                yield pa.RecordBatch.from_arrays([*others, _lists(size, pa.array(flat))], names_out)

    shape = kept.withColumn(split, F.array().cast("array<string>")) if more else kept
    return cut.mapInArrow(rows, shape.withColumn(out, F.array().cast("array<bigint>")).schema), rest if more else None, split


def rare_tokens(found: DataFrame, rest: DataFrame, gaps: str, key: str) -> DataFrame:
    """key and the tokens of the pieces in gaps, in their order, for rows that have any; key is unique."""
    ids = found.select(key, F.posexplode(gaps).alias("pos", "piece")).join(rest.select("piece", "token"), "piece", "left")
    token = F.coalesce("token", F.lit(UNK).cast("long")).alias("token")
    by_row = ids.select(key, "pos", token).repartition(key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return by_row.select(key, F.col("x.token").alias(gaps))


def filled(found: DataFrame, gaps: str, out: str) -> DataFrame:
    """found (out, gaps) with the tokens in gaps put in place of the -1 of out, in their order, and without gaps."""
    at, to = found.columns.index(gaps), found.columns.index(out)
    names = [c for c in found.columns if c != gaps]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, _sizes(whole.column(to)), AT_ONCE):
                flat = np.array(b.column(to).flatten())
                flat[flat < 0] = b.column(at).flatten().to_numpy()
                lists = _lists(_sizes(b.column(to)), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([lists if i == to else c for i, c in enumerate(b.columns) if i != at], names)

    return found.mapInArrow(rows, found.drop(gaps).schema)


def decode(docs: DataFrame, vocab: DataFrame, key: str | None = None) -> DataFrame:
    """docs (tokens) with `decoded`: the pieces of its tokens, joined by spaces; tokens that vocab doesn't have give none. The
    frequent part of the vocabulary is broadcast; tokens of the rest are joined, and only their pieces travel to the documents.
    key is a column of docs without nulls or repeats, if it has one; else documents are numbered and written."""
    limit, head = _frequent(vocab, FIRST_WORD + BROADCAST_PIECES)
    shared = docs.sparkSession.sparkContext.broadcast((head["piece"].combine_chunks(), head["token"].to_numpy()))
    rest = vocab.where(F.col("token") >= limit)
    columns, gaps = docs.columns, free_name(docs.columns, "gaps")
    more = not rest.isEmpty()
    if more:
        if key is None:
            key = free_name(docs.columns, "row")
            docs = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "decoded")
        rare = docs.select(key, F.posexplode(F.filter("tokens", lambda t: t >= limit)).alias("pos", "token"))
        met = rare.join(rest.select("token", "piece"), "token", "left").select(key, "pos", "piece").repartition(key)
        words = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("x")).select(key, F.col("x.piece").alias(gaps))
        docs = docs.join(words, key, "left").select(*columns, gaps)
    at = docs.columns.index("tokens")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = shared.value
        order = np.argsort(ids)
        names, ids = names.take(pa.array(order)).cast(pa.string()), ids[order]
        for whole in batches:
            for b in portions(whole, _sizes(whole.column(at)), AT_ONCE):
                flat = b.column(at).flatten().to_numpy()
                found = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
                words = names.take(pa.array(found, mask=ids[found] != flat)) if len(ids) else pa.nulls(len(flat), pa.string())
                if more:
                    words = pc.replace_with_mask(words, pa.array(flat >= limit), b.column(len(columns)).flatten().cast(pa.string()))
                there = np.concatenate([[0], np.cumsum(words.is_valid().to_numpy(zero_copy_only=False))])
                ends = there[np.concatenate([[0], np.cumsum(_sizes(b.column(at)))])]
                decoded = pc.binary_join(_lists(np.diff(ends), words.drop_null()), " ")
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], decoded], [*columns, "decoded"])

    return docs.mapInArrow(rows, docs.select(*columns).withColumn("decoded", F.lit("").cast("string")).schema)


def lengths(docs: DataFrame, text: str = "text", eos: bool = True, bos: bool = False) -> DataFrame:
    """docs with n_pieces and n_items, separators included."""
    return docs.withColumn("n_pieces", F.size(pieces(text)).cast("long")).withColumn("n_items", F.col("n_pieces") + (int(eos) + int(bos)))


def offsets(sized: DataFrame, order: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """sized with start and end of each document in the stream of its group."""
    return running(sized, order, F.col("n_items"), "end", by).withColumn("start", F.col("end") - F.col("n_items"))


def assembled(tokens: str = "tokens", eos: bool = True, bos: bool = False) -> F.Column:
    """A document's items: its tokens between the separators."""
    one = lambda v: [F.array(F.lit(v).cast("long"))]
    return F.concat(*(one(BOS) if bos else []), F.col(tokens), *(one(EOS) if eos else []))


def stream(placed: DataFrame, items: str = "items") -> DataFrame:
    """doc_id, position, token of every item; placed has doc_id, start and an array of items."""
    return placed.select("doc_id", "start", F.posexplode(items).alias("pos", "token")).select("doc_id", (F.col("start") + F.col("pos")).alias("position"), "token")


def cut_items(placed: DataFrame, size: int, items: str = "items", by: tuple[str, ...] = ()) -> DataFrame:
    """shard, lo, part: the slice of a document's items in each shard that it touches. A document's slices are made in its row,
    so a long one isn't copied for each of them."""

    def one(k: F.Column) -> F.Column:
        lo, hi = F.greatest(F.col("start"), k * size), F.least(F.col("end"), (k + 1) * size)
        return F.struct(k.alias("shard"), lo.alias("lo"), F.slice(items, (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    touched = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))
    return placed.where("end > start").select(*by, F.explode(F.transform(touched, one)).alias("x")).select(*by, "x.shard", "x.lo", "x.part")


def chunks(placed: DataFrame, size: int, items: str = "items", by: tuple[str, ...] = (), span: int | None = None) -> DataFrame:
    """chunk, lo, tokens: blocks of `size` items in stream order, the storage form of a split. Each document
    sends a slice of its array to the chunks that it touches. With a span, so many chunks that follow each other go to one task."""
    cut, keys = cut_items(placed, size, items, by).withColumnRenamed("shard", "chunk"), [*by, "chunk"]
    if span is not None:
        block = free_name(cut.columns, "block")
        cut = cut.withColumn(block, F.floor(F.col("chunk") / span))
        cut, keys = cut.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, block), [*by, block, "chunk"]
    met = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("x"))
    return met.select(*by, "chunk", (F.col("chunk") * size).alias("lo"), F.flatten("x.part").alias("tokens"))


def shard_pieces(placed: DataFrame, shard_items: int) -> DataFrame:
    """One row per document and shard that it touches: shard, lo, hi (stream positions)."""
    shard = F.explode(F.sequence(F.floor(F.col("start") / shard_items), F.floor((F.col("end") - 1) / shard_items)))
    cut = placed.where("end > start").withColumn("shard", shard)
    return cut.withColumn("lo", F.greatest("start", F.col("shard") * shard_items)).withColumn("hi", F.least("end", (F.col("shard") + 1) * shard_items))
