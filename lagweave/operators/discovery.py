"""Pathways, feature groups, screening and consistency of selected features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pathways(modalities: DataFrame, never_source: Sequence[str] = (), source_only: Sequence[str] = ()) -> DataFrame:
    """(src, tgt): all ordered pairs, without sources of ``never_source`` and targets of ``source_only``.

    ``modalities`` is a dimension of a few rows.
    """
    src = modalities.select(F.col("modality").alias("src")).where(~F.col("src").isin(list(never_source)))
    tgt = modalities.select(F.col("modality").alias("tgt")).where(~F.col("tgt").isin(list(source_only)))
    return src.crossJoin(F.broadcast(tgt))


def pathway_category(src: Column, tgt: Column, rules: Sequence[tuple[str, str, str]], slow_target: str, default: str) -> Column:
    """Category of a pathway: the slow target always, then an exact rule, ``*`` as source, ``*`` as target, default."""
    out = F.when(tgt == slow_target, "slow")
    rank = lambda r: (r[0] == "*") + 2 * (r[1] == "*")
    for s, t, category in sorted(rules, key=rank):
        fits = F.lit(True)
        if s != "*":
            fits = fits & (src == s)
        if t != "*":
            fits = fits & (tgt == t)
        out = out.when(fits, category)
    return out.otherwise(default)


def elements(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, channel, x): one row for each element."""
    return vectors.select(F.col(id_col).alias("id"), F.posexplode(vector).alias("channel", "x")).withColumn("x", F.col("x").cast("double"))


def adjacent_groups(vectors: DataFrame, vector: str, n_channels: int, least: float) -> DataFrame:
    """(channel, rho, grp): channels join the group before them if |correlation| with it is over ``least``.

    All neighbouring correlations come from one aggregate over the arrays, without exploding them.
    """
    x = [F.col(vector)[c].cast("double") for c in range(n_channels)]
    rhos = vectors.agg(F.array(F.lit(None).cast("double"), *[F.corr(x[c - 1], x[c]) for c in range(1, n_channels)]).alias("r"))
    each = rhos.select(F.posexplode("r").alias("channel", "rho"))
    new = F.when(F.abs("rho") > least, 0).otherwise(1)
    return each.withColumn("grp", F.sum(new).over(Window.orderBy("channel")) - 1)


def rms(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, rms): root of the mean square over channels, inside the row."""
    total = F.aggregate(F.col(vector), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return vectors.select(id_col, F.sqrt(total / F.size(vector)).alias("rms"))


def sis_topk(vectors: DataFrame, vector: str, target: str, n_channels: int, k: int) -> DataFrame:
    """(channel, score, rank): the ``k`` channels of largest |sum of x times the centred target| / n.

    One pass of n_channels partial sums; ties go to the lower channel.
    """
    x = [F.col(vector)[c].cast("double") for c in range(n_channels)]
    y = F.col(target).cast("double")
    sums = vectors.agg(F.array(*[F.sum(c * y) - F.sum(c) * F.avg(y) for c in x]).alias("s"), F.count("*").alias("n"))
    each = sums.select("n", F.posexplode("s").alias("channel", "v")).select("channel", F.round(F.abs("v") / F.col("n"), 9).alias("score"))
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "channel"))).where(F.col("rank") <= k)


def consistency(selected: DataFrame, by: Sequence[str], unit: str, least: int) -> DataFrame:
    """(by, n): what is selected in at least ``least`` different units."""
    return selected.groupBy(*by).agg(F.count_distinct(unit).alias("n")).where(F.col("n") >= least)
