"""Circular-shift surrogates, empirical p-values and multiple-testing control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def circular_shifts(rows: DataFrame, keys: Sequence[str], n_rows: int, n_shifts: int, least: float = 0.1) -> DataFrame:
    """(keys, k, b, x_shifted): row b of shift k holds what stood s_k rows earlier, round the end.

    Shifts lie evenly between max(1, ``least`` n) and n less that. Each row moves to its new place, so
    there is no join at all: one expansion by the number of shifts.
    """
    low = max(1, int(least * n_rows))
    step = max(1, (n_rows - 2 * low) // max(1, n_shifts))
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low + k * step).alias("s")) for k in range(n_shifts)])
    moved = rows.withColumn("_s", F.explode(shifts))
    return moved.select(*keys, F.col("_s.k").alias("k"), F.pmod(F.col("b") + F.col("_s.s"), F.lit(n_rows)).alias("b"), F.col("x").alias("x_shifted"))


def empirical_p(real: DataFrame, null: DataFrame, keys: Sequence[str], value: str = "stat") -> DataFrame:
    """(keys, stat, n_null, p): (nulls at least as large + 1) / (nulls + 1)."""
    met = null.withColumnRenamed(value, "_null").join(real, list(keys))
    return met.groupBy(*keys, value).agg(F.count("*").alias("n_null"), ((F.sum((F.col("_null") >= F.col(value)).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def bh_fdr(tests: DataFrame, order: Sequence[str], family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """``p_adjusted`` and ``significant`` by Benjamini and Hochberg; a null p counts as 1.

    Tests of one family meet in one task: families are tables of pathways, not of time points.
    """
    base = tests.withColumn("_p", F.coalesce("p", F.lit(1.0)))
    up = Window.partitionBy(*family).orderBy("_p", *order)
    down = Window.partitionBy(*family).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = base.withColumns({"_r": F.row_number().over(up), "_n": F.count("*").over(Window.partitionBy(*family))})
    adjusted = F.least(F.min(F.col("_p") * F.col("_n") / F.col("_r")).over(down), F.lit(1.0))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") < alpha).drop("_p", "_r", "_n")


def null_z(real: DataFrame, null: DataFrame, keys: Sequence[str], value: str = "stat") -> DataFrame:
    """``z``: the statistic against mean and population deviation of its nulls; 0 without spread."""
    stats = null.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return real.join(stats, list(keys)).withColumn("z", F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def stouffer(z: DataFrame, keys: Sequence[str], channel: str, value: str = "z") -> DataFrame:
    """(keys, stouffer): sum over channels by the root of their number."""
    return z.groupBy(*keys).agg((F.sum(value) / F.sqrt(F.count_distinct(channel))).alias("stouffer"))


def covariance_sum(null: DataFrame, channel: str, draw: Sequence[str], value: str = "z") -> DataFrame:
    """(c_eff, divisor) of whitened pooling: the sum of all covariances between channels.

    The sum of a covariance matrix is the variance of the sum over channels, so no pair is formed.
    """
    per = null.groupBy(*draw).agg(F.sum(value).alias("s"), F.count_distinct(channel).alias("c"))
    total = F.greatest(F.var_samp("s"), F.lit(1e-4))
    return per.agg((F.max("c") * F.max("c") / total).alias("c_eff"), F.sqrt(total).alias("divisor"))


def max_t(real: DataFrame, null: DataFrame, family: Sequence[str], draw: str, value: str = "z") -> DataFrame:
    """(family, max_stat, p): the largest statistic against the largest of each null draw."""
    top = real.groupBy(*family).agg(F.max(value).alias("max_stat"))
    tops = null.groupBy(*family, draw).agg(F.max(value).alias("_null"))
    return top.join(tops, list(family)).groupBy(*family, "max_stat").agg(((F.sum((F.col("_null") >= F.col("max_stat")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def ragged_shuffle(rows: DataFrame, key: str, value: str, sizes: tuple[int, int], seed: int) -> DataFrame:
    """(key, b, x_shuffled): blocks of a size between ``sizes``, drawn by hash, in an order drawn by hash.

    Each stream has the rows 0 to n - 1. Blocks are one row each while they are cut and ordered, then
    every row moves to its new place.
    """
    low, high = sizes
    drawn = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"{s}:"), F.col(key), F.lit(":"), F.col("_block").cast("string"))), 1, 6), 16, 10).cast("int")
    blocks = rows.groupBy(key).agg(F.count("*").alias("_n")).select(key, "_n", F.explode(F.expr(f"sequence(0, cast(floor(_n / {low}) as int))")).alias("_block"))
    blocks = blocks.withColumn("_size", low + drawn(seed) % (high - low + 1))
    by = Window.partitionBy(key).orderBy("_block")
    blocks = blocks.withColumn("_start", F.sum("_size").over(by) - F.col("_size")).where("_start < _n").withColumn("_len", F.least("_size", F.col("_n") - F.col("_start"))).withColumn("_turn", drawn(seed + 1))
    blocks = blocks.withColumn("_dest", F.sum("_len").over(Window.partitionBy(key).orderBy("_turn", "_block")) - F.col("_len"))
    places = blocks.select(key, "_start", "_dest", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_len") - 1)).alias("_b"))
    moved = rows.select(key, F.col("b").cast("long").alias("_b"), value).join(places, [key, "_b"])
    return moved.select(key, (F.col("_dest") + F.col("_b") - F.col("_start")).cast("int").alias("b"), F.col(value).alias("x_shuffled"))
