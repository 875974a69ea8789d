"""Random windows and mixtures. Draws that must equal numpy's are made by numpy, per index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform_starts(spark: SparkSession, n: int, total: int, block: int, seed: int) -> DataFrame:
    """window, start: n starts drawn as Generator.integers(0, total - block + 1, size=n) draws them."""
    if not 0 < block <= total:
        raise ValueError(f"a window of {block} items doesn't fit a stream of {total}")
    starts = np.random.default_rng(seed).integers(0, total - block + 1, size=n)
    return spark.createDataFrame(pa.table({"window": np.arange(n), "start": starts}))


def indexed_draws(spark: SparkSession, n: int, weights: list[tuple[str, float, int]], block: int, seed: int) -> DataFrame:
    """window, source, start: draw i depends on (seed, i) alone, so partitioning doesn't matter.
    weights: (source, weight, items); sources of weight 0 are left out."""
    live = [(s, w, t) for s, w, t in weights if w > 0]
    p = np.array([w for _, w, _ in live], float)
    p = p / p.sum()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            source, start = [], []
            for i in ids:
                rng = np.random.default_rng(np.random.SeedSequence(entropy=seed, spawn_key=(i,)))
                k = int(rng.choice(len(live), size=1, p=p)[0])
                source.append(live[k][0])
                start.append(int(rng.integers(0, live[k][2] - block + 1, size=1)[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(source, pa.string()), pa.array(start, pa.int64())], ["window", "source", "start"])

    return spark.range(n).mapInArrow(rows, "window long, source string, start long")


def arithmetic_starts(spark: SparkSession, n: int, total: F.Column | int, block: int, seed: int) -> DataFrame:
    """window, start from a fixed linear congruence: the same on every engine."""
    x = F.pmod(F.col("id") * 1103515245 + seed * 12345 + 12345, F.lit(1 << 31))
    return spark.range(n).select(F.col("id").alias("window"), F.pmod(x, F.lit(total) - (block - 1)).cast("long").alias("start"))


def normalised(weights: DataFrame) -> DataFrame:
    """weights (source, ord, weight) -> positive ones with p and the cumulative cdf, in their order."""
    live = weights.where("weight > 0")
    total = F.sum("weight").over(Window.partitionBy())
    w = Window.partitionBy().orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return live.select("source", "ord", "weight", (F.col("weight") / total).alias("p"), (F.sum("weight").over(w) / total).alias("cdf"))


def choose(draws: DataFrame, mix: DataFrame) -> DataFrame:
    """draws (window, u in [0, 1)) -> window, source, by the cdf. A mixture has few sources, so it is broadcast."""
    m = mix.agg(F.array_sort(F.collect_list(F.struct("ord", "cdf", "source"))).alias("mix"))
    return draws.join(F.broadcast(m)).select("window", F.element_at(F.filter("mix", lambda s: s["cdf"] > F.col("u")), 1)["source"].alias("source"))
