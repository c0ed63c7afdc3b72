"""Stability and block selection of source groups, higher criticism, and the pathway decision.

A resample is a key: rows are expanded to the halves or blocks they fall in, moments are summed with
map-side combination, and each small problem is solved where its moments land.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.functions.tails import binom_sf, hypergeom_sf
from lagweave.operators.regression import group_lasso, moments


def stability(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], groups: Sequence[str], y: str, alpha: float, draws: int = 20, least: float = 0.6) -> DataFrame:
    """(keys, grp, share, stable): how often a group is selected over half-samples of contiguous blocks.

    Halves are drawn by the hash of block and draw, so they don't depend on how rows are dealt out.
    """
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).where(F.pmod(F.xxhash64(F.floor(F.col("b") / 8), F.col("draw")), F.lit(2)) == 0)
    chosen = group_lasso(moments(drawn, [*keys, "draw"], [*columns, y]), [*keys, "draw"], groups, alpha)
    return chosen.groupBy(*keys, "grp").agg(F.avg(F.col("selected").cast("double")).alias("share")).withColumn("stable", F.col("share") >= least)


def blocks(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], groups: Sequence[str], y: str, alpha: float, block: int, rate: float = 0.05) -> DataFrame:
    """(keys, grp, hits, n_blocks, p): selections over contiguous blocks against a binomial of ``rate``."""
    cut = rows.withColumn("block", F.floor(F.col("b") / block))
    chosen = group_lasso(moments(cut, [*keys, "block"], [*columns, y]), [*keys, "block"], groups, alpha)
    out = chosen.groupBy(*keys, "grp").agg(F.sum(F.col("selected").cast("int")).alias("hits"), F.count("*").cast("int").alias("n_blocks"))

    def tail(frames):
        for f in frames:
            yield f.assign(p=[binom_sf(int(h), int(n), rate) for h, n in zip(f["hits"], f["n_blocks"])])

    return out.mapInPandas(tail, T.StructType([*out.schema.fields, T.StructField("p", T.DoubleType())]))


def decide(stable: DataFrame, block: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(keys, n_groups, n_stable, n_block, n_both, p_overlap, selected): groups that both ways agree on.

    The overlap is tested by the hypergeometric tail; with under two shared groups, or a p of
    ``alpha`` or more, nothing is selected.
    """
    met = stable.join(block, [*keys, "grp"]).withColumn("hit", F.col("p") < alpha)
    n = lambda c: F.sum(c.cast("int")).cast("int")
    both = F.col("stable") & F.col("hit")
    sums = met.groupBy(*keys).agg(F.count("*").cast("int").alias("n_groups"), n(F.col("stable")).alias("n_stable"), n(F.col("hit")).alias("n_block"), n(both).alias("n_both"), F.sort_array(F.collect_list(F.when(both, F.col("grp")))).alias("agreed"))

    def tail(frames):
        for f in frames:
            p = [hypergeom_sf(i, g, s, b) if min(i, g, s, b) > 0 else 1.0 for i, g, s, b in zip(f["n_both"], f["n_groups"], f["n_stable"], f["n_block"])]
            yield f.assign(p_overlap=p)

    tested = sums.mapInPandas(tail, T.StructType([*sums.schema.fields, T.StructField("p_overlap", T.DoubleType())]))
    return tested.withColumn("selected", F.when((F.col("n_both") >= 2) & (F.col("p_overlap") < alpha), F.col("agreed")).otherwise(F.expr("cast(array() as array<string>)"))).drop("agreed")


def higher_criticism(tests: DataFrame, family: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(family, hc): the largest standardised excess of small p-values, over the lower half of them."""
    w = Window.partitionBy(*family)
    ranked = tests.withColumns({"_i": F.row_number().over(w.orderBy("p", *order)), "_n": F.count("*").over(w)})
    p = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    score = F.sqrt("_n") * (F.col("_i") / F.col("_n") - p) / F.sqrt(p * (1 - p))
    return ranked.where(F.col("_i") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).groupBy(*family).agg(F.max(score).alias("hc"))


def block_shuffle(rows: DataFrame, keys: Sequence[str], block: int, draw: int) -> DataFrame:
    """(keys, b, x_shuffled): whole blocks of rows in an order drawn by the MD5 of draw and block, the same for all streams.

    Blocks are ordered as one row each, then every row moves to its new place.
    """
    cut = rows.select(*keys, "b", "x").withColumn("_block", F.floor(F.col("b") / block))
    turn = F.md5(F.concat(F.lit(f"{draw}:"), F.col("_block").cast("string")))
    sizes = cut.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.min("b").alias("_low"))
    w = Window.partitionBy(*keys).orderBy(turn, "_block")  # a row a block
    placed = sizes.select(*keys, "_block", "_low", (F.sum("_n").over(w) - F.col("_n")).alias("_dest"))
    return cut.join(placed, [*keys, "_block"]).select(*keys, (F.col("_dest") + F.col("b") - F.col("_low")).cast("int").alias("b"), F.col("x").alias("x_shuffled"))
