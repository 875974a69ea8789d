"""Operator 9: packing into length buckets that are optimal for the corpus.

Documents are cut into pieces of at most MAX_LEN tokens (here: words between ASCII white space).
The histogram of piece lengths over all documents has at most MAX_LEN rows; dynamic programming
over it picks the bucket boundaries with the least padding. Within a bucket every piece is padded
to the boundary, so a batch holds budget // boundary pieces; pieces are numbered by doc_id and
piece, and the number gives the batch.

Numbers are running sums over range partitions (storage.running), so no task holds a bucket, whatever
the doc_ids are. A document without tokens, or null, is one piece of length 0 in batch 0 of bucket 0.
Repeated rows are packed each; they are equal, so it doesn't matter in which order. Rows without a doc_id come first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import numbered

MAX_LEN, BUCKETS, BUDGET = 2048, 12, 16384


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` upper bounds, of which the last is the greatest length, so that the padding
    sum(count * (bound - length)) is least; the fewest bounds among equals, then the smaller ones."""
    order = np.argsort(length)
    x, c = length[order].astype(np.int64), count[order].astype(np.int64)
    n = len(x)
    if not n:
        return []
    pieces, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = (pieces[1:][None, :] - pieces[:-1][:, None]) * x[None, :] - (tokens[1:][None, :] - tokens[:-1][:, None])
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.iinfo(np.int64).max // 4)  # cost[i, j]: lengths i..j in one bucket
    best, back = cost[0].copy(), [np.zeros(n, np.int64)]
    totals = [int(best[-1])]
    for _ in range(1, min(buckets, n)):
        before = np.concatenate([[np.iinfo(np.int64).max // 4], best[:-1]])
        total = before[:, None] + cost
        back.append(total.argmin(0))
        best = total.min(0)
        totals.append(int(best[-1]))
    k = int(np.argmin(totals))
    out, j = [], n - 1
    while True:
        out.append(int(x[j]))
        if k == 0:
            return out[::-1]
        j = int(back[k][j]) - 1
        k -= 1


def words_in(text: str = "text") -> F.Column:
    """Number of words between ASCII white space, without an array of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit("[^ \\t-\\r]+")).cast("long")


def pack(docs: DataFrame, text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, n_tokens, bucket (its bound), batch, pad."""
    pieces = (
        docs.select("doc_id", words_in(text).alias("n"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("n") - 1).cast("long") - F.greatest(F.lit(0), F.col("n") - 1) % max_len, F.lit(max_len).cast("long"))))
        .select("doc_id", (F.col("piece") / max_len).cast("long").alias("piece"), F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece")).alias("n_tokens"))
    )
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().toArrow()  # at most max_len rows
    bounds = boundaries(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), buckets)
    bucket = F.lit(0).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    bucket = F.when(F.col("n_tokens") == 0, F.lit(0).cast("long")).otherwise(bucket)
    placed = numbered(pieces.withColumn("bucket", bucket), ["doc_id", "piece"], "row", ("bucket",))
    per = F.when(F.col("bucket") > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")))).otherwise(F.lit(1 << 62))
    return placed.select("doc_id", "piece", "n_tokens", "bucket", F.floor(F.col("row") / per).cast("long").alias("batch"), (F.col("bucket") - F.col("n_tokens")).alias("pad"))
