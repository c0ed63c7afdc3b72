"""Condition intervals from markers, time-point classes, and summaries by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition_intervals(markers: DataFrame, durations: DataFrame) -> DataFrame:
    """(session_id, condition, t_start, t_stop) from ``<condition>_start`` and ``<condition>_stop`` markers.

    Sorted by time, then label. A start before the stop replaces an earlier open one, a stop without
    a start is dropped, an open interval ends with the session; times are clamped to 0 and the
    duration (session_id, duration), and an interval that then doesn't end after its start is dropped.
    """
    parts = markers.where(F.col("label").rlike("_(start|stop)$")).select(
        "session_id", "t", "label", F.regexp_replace("label", "_(start|stop)$", "").alias("condition"), F.col("label").endswith("_start").alias("starts")
    )
    w = Window.partitionBy("session_id", "condition").orderBy("t", "label")
    chained = parts.withColumns({"before": F.lag(F.struct("starts", "t")).over(w), "after": F.lead("t").over(w)})
    closed = chained.where(~F.col("starts") & F.coalesce("before.starts", F.lit(False))).select("session_id", "condition", F.col("before.t").alias("t_start"), F.col("t").alias("t_stop"))
    open_ = chained.where(F.col("starts") & F.col("after").isNull()).select("session_id", "condition", F.col("t").alias("t_start"), F.lit(None).cast("double").alias("t_stop"))
    out = closed.union(open_).join(durations, "session_id")
    stop = F.least(F.coalesce("t_stop", "duration"), F.col("duration"))
    return out.select("session_id", "condition", F.greatest("t_start", F.lit(0.0)).alias("t_start"), stop.alias("t_stop")).where("t_stop > t_start")


def merged(intervals: DataFrame) -> DataFrame:
    """(session_id, condition, t_start, t_stop) with overlapping intervals of one condition made one."""
    w = Window.partitionBy("session_id", "condition").orderBy("t_start", "t_stop")
    reach = F.max("t_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(reach >= F.col("t_start"), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("session_id", "condition", "_run").agg(F.min("t_start").alias("t_start"), F.max("t_stop").alias("t_stop")).drop("_run")


def classify(a: Column, b: Column, cut_a: Column, cut_b: Column) -> Column:
    """0 none, 1 only a over its cut, 2 only b, 3 both."""
    return (a > cut_a).cast("int") + 2 * (b > cut_b).cast("int")


def with_conditions(rows: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """``rows`` (session_id, t, ...) once for each condition they lie in, ends included.

    Intervals are dealt into buckets of ``width`` seconds and joined on session and bucket, so the
    range join is an equi-join; a row in two intervals of one condition counts once, equal rows each.
    """
    intervals = merged(intervals)
    first, last = F.floor(F.col("t_start") / width).cast("long"), F.floor(F.col("t_stop") / width).cast("long")
    dealt = intervals.withColumn("_k", F.explode(F.sequence(first, last)))
    keyed = rows.withColumn("_k", F.floor(F.col("t") / width).cast("long"))
    met = keyed.join(dealt, ["session_id", "_k"]).where(F.col("t").between(F.col("t_start"), F.col("t_stop")))
    return met.drop("_k", "t_start", "t_stop")


def condition_stats(rows: DataFrame, intervals: DataFrame, dt: float, width: float) -> DataFrame:
    """Per session and condition, 'uncategorized' and 'all': samples, duration, shares of classes, means.

    ``rows``: (session_id, t, label, a, b). Conditions without rows are left out.
    """
    inside = with_conditions(rows, intervals, width)
    outside = rows.join(inside.select("session_id", "t").distinct(), ["session_id", "t"], "left_anti")
    fanned = inside.select("session_id", "condition", "t", "label", "a", "b").unionByName(outside.withColumn("condition", F.lit("uncategorized")).select("session_id", "condition", "t", "label", "a", "b")).unionByName(rows.withColumn("condition", F.lit("all")).select("session_id", "condition", "t", "label", "a", "b"))
    share = lambda k: F.avg((F.col("label") == k).cast("double")) * 100
    return fanned.groupBy("session_id", "condition").agg(
        F.count("*").alias("n"), (F.count("*") * dt).alias("duration"), share(0).alias("pct_none"), share(1).alias("pct_a"), share(2).alias("pct_b"), share(3).alias("pct_both"),
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.max(F.greatest("a", "b")).alias("peak"),
    )


def grand_summary(stats: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation and count over sessions for each condition."""
    return stats.groupBy("condition").agg(F.avg(value).alias("grand_mean"), F.stddev_pop(value).alias("grand_sd"), F.count(value).alias("n_sessions"))


def adaptive_cut(rows: DataFrame, keys: list[str], value: str, quantile: float = 0.5) -> DataFrame:
    """Exact quantile of each stream, interpolated linearly."""
    return rows.groupBy(*keys).agg(F.percentile(value, F.lit(quantile)).alias("cut"))
