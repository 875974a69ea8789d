"""Weighted mixtures of written sources. Draws are numpy's, made in a fixed order; windows are read by tasks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import isfinite
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, integer
from ..sinks import atomic_json, valid_name
from .sample import indexed_draws
from .source import Source, draw_starts, read_source


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights of valid names, finite, not below 0 and with a sum over 0."""
    if not isinstance(weights, dict) or not weights:
        raise EngineError("F109", "a mixture needs weights by source")
    for name, w in weights.items():
        valid_name(name)
        if isinstance(w, bool) or not isinstance(w, (int, float)) or not isfinite(w) or w < 0:
            raise EngineError("F109", f"the weight of {name} is {w!r}")
    if not sum(weights.values()) > 0:
        raise EngineError("F109", "all weights are 0")
    return {k: float(v) for k, v in weights.items()}


def write_mix(root: str | Path, weights: dict[str, float]) -> None:
    atomic_json(Path(root) / "mix.json", checked_weights(weights))


@dataclass
class Mixture:
    """Sources of positive weight, in the order of the weights, with their shares p."""

    sources: list[tuple[str, Source]]
    p: np.ndarray

    @classmethod
    def open(cls, root: str | Path, weights: dict[str, float] | None = None, split: str = "train") -> "Mixture":
        """From weights, or from root/mix.json. Sources of weight 0 aren't opened."""
        from_file = weights is None
        if weights is None:
            at = Path(root) / "mix.json"
            if not at.is_file():
                raise EngineError("F108", f"{at} doesn't exist", fix="write_mix(), or give weights")
            weights = json.loads(at.read_text(encoding="utf-8"))
        live = {k: w for k, w in checked_weights(weights).items() if w > 0}
        missing = [k for k in live if not (Path(root) / k).is_dir()]
        if missing:
            raise EngineError("F110" if from_file else "C305", f"{root} has no source {', '.join(missing)}")
        sources = [(k, read_source(Path(root) / k, split)) for k in live]
        if len({s.tokenizer_hash for _, s in sources}) > 1:
            raise EngineError("K208", "the sources have different tokenizers")
        w = np.array(list(live.values()))
        return cls(sources, w / w.sum())

    @property
    def dtype(self) -> str:
        """The widest item type of the sources."""
        return max((s.dtype for _, s in self.sources), key=lambda d: np.dtype(d).itemsize)

    def choose(self, n: int, rng: np.random.Generator) -> np.ndarray:
        if not isinstance(rng, np.random.Generator):
            raise EngineError("C308", "rng must be a numpy Generator")
        return rng.choice(len(self.sources), size=integer(n, "n", 0), p=self.p)

    def batch(self, spark: SparkSession, n: int, block: int, rng: np.random.Generator) -> DataFrame:
        """row, source, start, tokens of n windows. All sources are drawn first, then for each source in order the
        starts of its rows."""
        chosen = self.choose(n, rng)
        starts = np.zeros(n, np.int64)
        for k, (_, s) in enumerate(self.sources):
            at = np.flatnonzero(chosen == k)
            if len(at):
                starts[at] = draw_starts(s.n_items, len(at), block, rng)
        names = np.array([name for name, _ in self.sources])
        draws = pa.table({"window": np.arange(n), "source": names[chosen].tolist(), "start": starts})
        return self._read(spark.createDataFrame(draws), block)

    def indexed(self, spark: SparkSession, n: int, block: int, seed: int) -> DataFrame:
        """row, source, start, tokens of items 0 .. n; item i depends on (seed, i) alone."""
        return self._read(indexed_draws(spark, n, [(k, p, s.n_items) for (k, s), p in zip(self.sources, self.p)], block, seed), block)

    def _read(self, draws: DataFrame, block: int) -> DataFrame:
        out = None
        for name, s in self.sources:
            mine = draws.where(F.col("source") == name).select("window", "start", F.lit(block).alias("length"))
            part = s.windows(mine).select(F.col("window").alias("row"), F.lit(name).alias("source"), "start", "tokens")
            out = part if out is None else out.unionByName(part)
        return out
