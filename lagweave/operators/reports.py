"""What a validation run amounts to: false alarms, power, specificity, patterns and directions over its results.

Results are rows (sub, session, modality, kappa, pattern, truth, found, auc, recovered), one a tested pathway of a
session; ``truth`` tells whether it was coupled. A session detects if any coupled pathway of it is found.
Everything is one or two aggregates, so a run may have any number of sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hit():  # noqa: ANN202
    return F.col("truth") & F.col("found")


def _alarm():  # noqa: ANN202
    return ~F.col("truth") & F.col("found")


def _n(condition):  # noqa: ANN001, ANN202
    return F.sum(condition.cast("int")).cast("long")


def _aucs() -> list:
    return [F.avg("auc").alias("auc"), F.min("auc").alias("auc_least"), F.max("auc").alias("auc_most")]


def sessions(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, session, detected, recovered, aucs): one row a session, its means weighed by their number."""
    return results.groupBy(*keys, "session").agg(F.max(_hit().cast("int")).alias("detected"), F.max(F.coalesce(F.col("recovered"), F.lit(False)).cast("int")).alias("recovered"), F.sum("auc").alias("auc_sum"), F.count("auc").alias("auc_n"))


def false_alarms(results: DataFrame, most: float = 0.1) -> DataFrame:
    """(sub, n_alarms, n_pathways, rate, passed) of null controls: the share of pathways found among all tested."""
    out = results.groupBy("sub").agg(_n(_alarm()).alias("n_alarms"), F.count("*").alias("n_pathways"))
    return out.withColumn("rate", F.col("n_alarms") / F.col("n_pathways")).withColumn("passed", F.col("rate") <= most)


def power_curve(results: DataFrame, power: float = 0.8) -> DataFrame:
    """(modality, kappa, n, rate, auc, least_kappa): detection by strength, and the least strength that reaches ``power``.

    ``kappa`` is null in the row of all strengths of a modality, and both are null in the row of all; the
    least strength is the first in ascending order, null if none reaches it.
    """
    by = sessions(results, ["modality", "kappa"])
    sums = by.groupingSets([["modality", "kappa"], ["modality"], []], "modality", "kappa").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg("detected").alias("rate"), (F.sum("auc_sum") / F.nullif(F.sum("auc_n"), F.lit(0))).alias("auc"))
    reached = F.min(F.when((F.col("_g") == 0) & (F.col("rate") >= power), F.col("kappa"))).over(Window.partitionBy("modality", F.col("modality").isNull() & (F.col("_g") == 3)))
    return sums.withColumn("least_kappa", F.when(F.col("_g") < 3, reached)).drop("_g")


def specificity(results: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """(keys, n, n_detected, n_recovered, rate, passed): detection, and how often what was planted is what was found."""
    out = sessions(results, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("detected").cast("long").alias("n_detected"), F.sum("recovered").cast("long").alias("n_recovered"))
    return out.withColumn("rate", F.col("n_detected") / F.col("n")).withColumn("passed", F.col("rate") >= least)


def patterns(results: DataFrame, least: float = 0.5) -> DataFrame:
    """(pattern, n, rate, auc, auc_least, auc_most, passed) by pattern in time."""
    found = sessions(results, ["pattern"]).groupBy("pattern").agg(F.count("*").alias("n"), F.avg("detected").alias("rate"))
    return found.join(results.groupBy("pattern").agg(*_aucs()), "pattern").withColumn("passed", F.col("rate") >= least)


def directionality(results: DataFrame, forward: str, reverse: str, most: int = 1) -> DataFrame:
    """One row (n_forward, n_detected, n_reverse_alarms, passed): planted directions found, and alarms the other way."""
    here = F.col("sub") == forward
    rows = sessions(results, ["sub"]).agg(F.count(F.when(here, 1)).alias("n_forward"), F.coalesce(F.sum(F.when(here, F.col("detected"))), F.lit(0)).cast("long").alias("n_detected"))
    alarms = results.agg(F.coalesce(_n(_alarm() & (F.col("sub") == reverse)), F.lit(0)).alias("n_reverse_alarms"))
    return rows.crossJoin(F.broadcast(alarms)).withColumn("passed", F.col("n_reverse_alarms") <= most)
