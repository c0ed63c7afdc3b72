"""From samples to coupling: the whole chain as one lazily built plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.basis import raised_cosine
from lagweave.operators import regression, surrogates, temporal


@dataclass(frozen=True)
class Config:
    """Parameters of an analysis; ``merged`` gives a copy with some replaced."""

    bin_s: float = 21600.0
    n_basis: int = 3
    max_lag: float = 6.0
    ar_order: int = 3
    ridge: float = 1e-3
    alpha: float = 0.05
    min_dr2: float = 0.001
    excluded: tuple[str, ...] = field(default=())

    def merged(self, **changes) -> Config:
        return type(self)(**(self.__dict__ | changes))


def analyze(samples: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """(src, tgt, n, r2_full, r2_restricted, dr2, f_stat, p, p_adjusted, significant) of every ordered pair.

    ``samples`` (keys, t, x); the first key names the stream. Samples are aggregated onto the grid
    once; everything after works on the grid, which has one row a stream and bin.
    """
    name = keys[0]
    rows = temporal.grid(samples.where(~F.col(name).isin(list(config.excluded))), keys, config.bin_s)
    z = temporal.zscore_clip(rows, keys)
    basis, _ = raised_cosine(config.n_basis, config.max_lag, rate=1.0)
    lags = temporal.lag_convolution(z, keys, basis.tolist()).withColumnRenamed(name, "src")
    own = temporal.ar_terms(z, keys, config.ar_order).withColumnsRenamed({name: "tgt", "z": "y"})
    pairs = lags.join(own, [*keys[1:], "b"]).where("src <> tgt")
    out = regression.nested_ridge(pairs, [*keys[1:], "src", "tgt"], [f"c{j}" for j in range(config.n_basis)], [f"ar{k}" for k in range(1, config.ar_order + 1)], "y", config.ridge)
    tested = surrogates.bh_fdr(out, [*keys[1:], "src", "tgt"], keys[1:], config.alpha)
    return tested.withColumn("significant", F.col("significant") & (F.col("dr2") > config.min_dr2))
