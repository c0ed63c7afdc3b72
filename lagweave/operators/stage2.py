"""From screened pathways to decisions: surrogate tests, time courses, and what a run reports of each pathway."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.operators import regression, surrogates


def f_test(r2_full: Column, r2_restricted: Column, p_full: int, p_restricted: int, n: Column) -> Column:
    """F of the added predictors; 0 where they add nothing, floors on both degrees of freedom."""
    df1, df2 = max(p_full - p_restricted, 1), F.greatest(n - p_full, F.lit(1))
    return (F.greatest(r2_full - r2_restricted, F.lit(0.0)) / df1) / (F.greatest(1 - r2_full, F.lit(1e-10)) / df2)


def f_test_timecourse(rows: DataFrame, p_full: int, p_restricted: int, n: str = "n") -> DataFrame:
    """``rows`` (r2_full, r2_restricted, n) with ``f`` and ``p``; p is 1 with no more rows than predictors, or without R2.

    With two added predictors the tail is a power and stays in Catalyst; else Arrow batches have it.
    """
    df2 = F.col(n) - p_full
    out = rows.withColumn("f", f_test(F.col("r2_full"), F.col("r2_restricted"), p_full, p_restricted, F.col(n)))
    known = F.col("f").isNotNull() & ~F.isnan("f") & (df2 > 1)
    if p_full - p_restricted == 2:
        return out.withColumn("p", F.when(known, F.pow(1 + 2 * F.col("f") / df2, -df2 / 2)).otherwise(1.0))
    schema = out.withColumn("p", F.lit(0.0)).schema
    d1 = max(p_full - p_restricted, 1)

    def tail(frames):
        from lagweave.functions.tails import f_sf

        for frame in frames:
            yield frame.assign(p=[f_sf(f, d1, m - p_full) if f == f and f is not None and m - p_full > 1 else 1.0 for f, m in zip(frame["f"], frame[n])])

    return out.mapInPandas(tail, schema)


def corrected_f_test(rows: DataFrame, order: Sequence[str], family: Sequence[str], p_full: int, p_restricted: int, alpha: float = 0.05) -> DataFrame:
    """``f_test_timecourse`` with p-values adjusted by Benjamini and Hochberg in each family."""
    return surrogates.bh_fdr(f_test_timecourse(rows, p_full, p_restricted), order, family, alpha)


def surrogate_screen(pairs: DataFrame, shifted: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """(keys, stat, n_null, p, p_adjusted, significant): |mean x y| of each pathway against shifted sources.

    ``shifted`` has the draw ``k``. Products are averaged by key and draw in one aggregate each.
    """
    size = F.abs(F.avg(F.col(x) * F.col(y))).alias("stat")
    tests = surrogates.empirical_p(pairs.groupBy(*keys).agg(size), shifted.groupBy(*keys, "k").agg(size), keys)
    return surrogates.bh_fdr(tests, keys, (), alpha)


def decisions(series: DataFrame, screened: DataFrame, keys: Sequence[str], min_dr2: float = 0.001, cut: float = 0.5, min_fraction: float = 0.03) -> DataFrame:
    """(keys, mean_dr2, fraction, p_adjusted, significant): a pathway counts if it passed the screen, adds variance, and couples for a while.

    ``series`` (keys, b, dr2, posterior), nulls left out of means; ``fraction`` is the share of rows with a
    posterior over ``cut``. A mean below -``min_dr2`` rejects; between, the screen and the fraction decide.
    """
    sums = series.groupBy(*keys).agg(F.avg("dr2").alias("mean_dr2"), F.avg((F.coalesce("posterior", F.lit(0.0)) > cut).cast("double")).alias("fraction"))
    both = screened.select(*keys, "p_adjusted", F.col("significant").alias("passed")).join(sums, list(keys), "left")
    real = F.col("passed") & (F.coalesce("mean_dr2", F.lit(0.0)) >= min_dr2) & (F.coalesce("fraction", F.lit(0.0)) >= min_fraction)
    return both.select(*keys, "mean_dr2", "fraction", "p_adjusted", real.alias("significant"))


def calibrated_cut(null: DataFrame, keys: Sequence[str], value: str, cut: float, share: float = 0.1) -> DataFrame:
    """(keys, threshold): the 1 - ``share`` quantile over draws ``k`` of the fraction of rows over ``cut``."""
    fractions = null.groupBy(*keys, "k").agg(F.avg((F.col(value) > cut).cast("double")).alias("fraction"))
    return fractions.groupBy(*keys).agg(F.percentile("fraction", F.lit(1 - share)).alias("threshold"))


def kernel(weights: DataFrame, keys: Sequence[str], basis: Sequence[Sequence[float]]) -> DataFrame:
    """(keys, lag, h): the lag kernel of ``weights`` (keys, w: one weight a basis column)."""
    each = weights.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("lag"), F.array(*[F.lit(float(v)) for v in row]).alias("phi")) for s, row in enumerate(basis)])).alias("l"), "w")
    return each.select(*keys, "l.lag", F.aggregate(F.zip_with("w", "l.phi", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("h"))


def spectral_map(scores: DataFrame, keys: Sequence[str], channel: str, value: str, n_regions: int) -> DataFrame:
    """(keys, freq, region, size): root sum of squares of channel scores, a channel being freq * regions + region."""
    c = F.col(channel)
    return scores.groupBy(*keys, F.floor(c / n_regions).cast("int").alias("freq"), (c % n_regions).cast("int").alias("region")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("size"))


def above_floor(rows: DataFrame, freq: str, floor: float, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the columns zeroed below a frequency."""
    return rows.withColumns({c: F.when(F.col(freq) >= floor, F.col(c)).otherwise(0.0) for c in columns})


def trimmed(rows: DataFrame, keys: Sequence[str], edge: int) -> DataFrame:
    """``rows`` without the first and last ``edge`` of each key's span of b."""
    ends = rows.groupBy(*keys).agg(F.min("b").alias("_a"), F.max("b").alias("_z"))
    return rows.join(ends, list(keys)).where((F.col("b") >= F.col("_a") + edge) & (F.col("b") <= F.col("_z") - edge)).drop("_a", "_z")


def moderators(target: DataFrame, moderator: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``target`` with ``moderator``: another stream's value on its rows, standardised; 0 without spread or rows."""
    stats = moderator.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = moderator.join(stats, list(keys)).select(*keys, "b", F.when(F.col("_s") > 1e-8, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("moderator"))
    return target.join(z, [*keys, "b"], "left").withColumn("moderator", F.coalesce("moderator", F.lit(0.0)))


def estimated(design: DataFrame, selected: DataFrame, keys: Sequence[str], source: Sequence[str], own: Sequence[str], y: str, gamma: float) -> DataFrame:
    """(keys, b, r2_full, r2_restricted, dr2) of the selected pathways only: time courses by weighted least squares."""
    some = design.join(F.broadcast(selected.where("significant").select(*keys)), list(keys), "left_semi")
    return regression.ewls(some, keys, source, own, y, gamma)
