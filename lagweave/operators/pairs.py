"""Two people, two directions, several sessions: pairs of streams, pseudo-pairs and comparisons of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators import spans
from lagweave.operators.localize import valid_window
from lagweave.operators.temporal import Keys, asof, asof_lerp


def both_directions(rows: DataFrame, person: str, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """(sources, targets) with ``direction``: the first person's rows lead the second's, and the other way round."""
    name = F.when(F.col(person) == first, f"{first}-{second}").otherwise(f"{second}-{first}")
    other = F.when(F.col(person) == second, f"{first}-{second}").otherwise(f"{second}-{first}")
    some = rows.where(F.col(person).isin(first, second))
    return some.withColumn("direction", name).drop(person), some.withColumn("direction", other).drop(person)


def hash_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, place): distinct keys numbered from 0 in the order of the MD5 of seed and key, in parts by the first digits."""
    mixed = rows.select(key).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    mixed = mixed.withColumn("_part", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    return spans.running(mixed, [], ["_part", "_h"], {"place": ("sum", F.lit(1))}, 1, "_part").select(key, (F.col("place") - 1).alias("place"))


def cross_pairs(sessions: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(a, b): each session with the next one in an order drawn by hash, the last with the first."""
    placed = hash_order(sessions, key, seed)
    n = placed.agg(F.count("*").alias("n"))
    nxt = placed.select(F.col(key).alias("b"), F.col("place").alias("_at"))
    ahead = placed.crossJoin(F.broadcast(n)).withColumn("_at", F.pmod(F.col("place") + 1, F.col("n")))
    return ahead.join(nxt, "_at").select(F.col(key).alias("a"), "b").where("a <> b")


def valid_pairs(pairs_: DataFrame, rows: DataFrame, session: str, person: str, first: str, second: str, least: int) -> DataFrame:
    """(a, b, start, length) of the pairs whose people have a common valid window of ``least`` rows: the longest, earliest one.

    ``rows`` (session, person, b, valid) count from each session's own start: the first person of session a
    beside the second of session b.
    """
    good = rows.where("valid")
    one = good.where(F.col(person) == first).select(F.col(session).alias("_one"), "b").distinct()
    two = good.where(F.col(person) == second).select(F.col(session).alias("_two"), "b").distinct()
    both = pairs_.select(F.col("a").alias("_one"), F.col("b").alias("_two")).join(one, "_one").join(two, ["_two", "b"])
    found = valid_window(both.withColumn("_ok", F.lit(True)), ["_one", "_two"], "_ok", least)
    return found.select(F.col("_one").alias("a"), F.col("_two").alias("b"), "start", "length")


def pseudo_sessions(samples: DataFrame, pairs: DataFrame, session: str, person: str, first: str, second: str) -> DataFrame:
    """``samples`` of pairs (a, b) with ``pair``: the first person of session a beside the second of session b, on one clock from 0."""
    start = samples.groupBy(F.col(session).alias("_s")).agg(F.min("t").alias("_t0"))
    pair = F.concat_ws("+", F.col("a").cast("string"), F.col("b").cast("string"))
    one = samples.where(F.col(person) == first).join(pairs, F.col(session) == F.col("a"))
    two = samples.where(F.col(person) == second).join(pairs, F.col(session) == F.col("b"))
    return one.union(two).join(start, F.col(session) == F.col("_s")).withColumn("pair", pair).withColumn("t", F.col("t") - F.col("_t0")).drop("a", "b", "_s", "_t0")


def on_coarser(fine: DataFrame, coarse: DataFrame, keys: Keys, value: str) -> DataFrame:
    """(keys, t, coarse value, fine): two series on the times of the coarser one, the finer interpolated, missing as 0."""
    at = asof_lerp(asof(coarse.select(*keys, "t"), fine, keys, value)).select(*keys, "t", F.col("x").alias("fine"))
    return coarse.join(at, [*keys, "t"], "left").withColumns({"fine": F.coalesce("fine", F.lit(0.0)), value: F.coalesce(value, F.lit(0.0))})


def average_significant(series: DataFrame, decisions: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(direction, b, mean): the value averaged over the significant pathways (``keys``) of each direction."""
    chosen = decisions.where("significant").select(*keys).distinct()
    return series.join(F.broadcast(chosen), list(keys), "left_semi").groupBy("direction", "b").agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("mean"))


def feature_sets(consistent: DataFrame) -> DataFrame:
    """(pathway, n, features): the features that each pathway keeps, in order; pathways without any are left out."""
    return consistent.groupBy("pathway").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("feature")).alias("features"))


def summary_lines(sets: DataFrame) -> DataFrame:
    """(pathway, line): a sentence on each pathway's features."""
    few = F.array_join(F.slice("features", 1, 5), ", ")
    return sets.select("pathway", F.concat(F.col("pathway"), F.lit(": "), F.col("n").cast("string"), F.lit(" features ("), few, F.when(F.col("n") > 5, ", ...").otherwise(""), F.lit(")")).alias("line"))


def n_predictors(n_source: int, n_target: int, n_basis: int, order: int) -> tuple[int, int]:
    """Columns of the full and of the restricted design of a pathway."""
    return n_basis * n_source + order * n_target, order * n_target
