"""How well detections and scores agree with the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators import spans

#: Ranges of the scores of a ROC curve.
PARTS = 200


def roc_auc(scored: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums with tied ranks; null if one class is missing.

    Scores are counted first and cumulated by distinct value, in ranges of ``PARTS`` quantiles with the
    counts of lower ranges carried over, so no task orders all values.
    """
    per = scored.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    edges = per.agg(F.percentile_approx(score, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])).alias("_edges"))
    part = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(score))), F.lit(0))
    per = per.crossJoin(F.broadcast(edges)).withColumn("_part", part).drop("_edges")  # one row of edges
    before = spans.running(per, keys, ["_part", score], {"below": ("sum", F.col("n") - F.col("p"))}, 1, "_part", inclusive=False).withColumn("below", F.coalesce("below", F.lit(0)))
    sums = before.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + 0.5 * (F.col("n") - F.col("p")))).alias("u"), F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"))
    return sums.select(*keys, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def timing(rows: DataFrame, keys: Sequence[str], truth: str, found: str, gate: str, posterior: str) -> DataFrame:
    """Hit rate, false-alarm rate, intersection over union, correlation and duties by stream."""
    t, f = F.col(truth), F.col(found)
    n = lambda c: F.sum(c.cast("int"))
    return rows.groupBy(*keys).agg(
        F.when(n(t) > 0, n(t & f) / n(t)).alias("hit_rate"), F.when(n(~t) > 0, n(~t & f) / n(~t)).alias("false_alarm"),
        F.when(n(t | f) > 0, n(t & f) / n(t | f)).alias("iou"), F.corr(gate, posterior).alias("r"), F.avg(t.cast("int")).alias("duty_true"), F.avg(f.cast("int")).alias("duty_found"),
    )


def rates_by_bin(rows: DataFrame, value: str, edges: Sequence[float], hit: str, positive: str) -> DataFrame:
    """True- and false-positive rates in half-open bins [edge, next edge) of ``value``."""
    place = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        place = F.when((F.col(value) >= edges[k]) & (F.col(value) < edges[k + 1]), k).otherwise(place)
    p, h = F.col(positive), F.col(hit)
    n = lambda c: F.sum(c.cast("int"))
    return rows.withColumn("bin", place).where("bin is not null").groupBy("bin").agg(
        F.count("*").alias("n"), F.when(n(p) > 0, n(p & h) / n(p)).alias("tpr"), F.when(n(~p) > 0, n(~p & h) / n(~p)).alias("fpr")
    )
