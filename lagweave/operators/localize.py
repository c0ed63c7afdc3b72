"""Where in time: CUSUM, clusters, event masks, likelihood-ratio masks and valid windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators import spans
from lagweave.operators.temporal import Keys, min_event, run_starts, runs


def cusum(rows: DataFrame, keys: Keys, value: str, centre: str, slack: float = 0.0) -> DataFrame:
    """``forward`` and ``backward``: C[t] = max(0, C[t-1] + x - centre - slack), C[0] = 0, and mirrored.

    In closed form: the running sum less its running minimum. Both directions are windows of one span; a span's
    total and least sum are carried over the others, one row each.
    """
    ends = rows.groupBy(*keys).agg(F.min("b").alias("_a"), F.max("b").alias("_z"))
    gain = F.col(value) - F.col(centre) - slack
    sides = {"forward": ("_a", F.asc), "backward": ("_z", F.desc)}
    out = rows.join(ends, list(keys)).withColumn("_span", F.floor(F.col("b") / spans.SPAN))
    upto = lambda turn: Window.partitionBy(*keys, "_span").orderBy(turn("b")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_s_{n}": F.sum(F.when(F.col("b") == F.col(edge), 0.0).otherwise(gain)).over(upto(turn)) for n, (edge, turn) in sides.items()})
    out = out.withColumns({f"_m_{n}": F.min(f"_s_{n}").over(upto(turn)) for n, (_, turn) in sides.items()})
    per = out.groupBy(*keys, "_span").agg(*[f for n, (edge, _) in sides.items() for f in (F.sum(F.when(F.col("b") == F.col(edge), 0.0).otherwise(gain)).alias(f"_t_{n}"), F.min(f"_s_{n}").alias(f"_l_{n}"))])
    before = lambda turn: Window.partitionBy(*keys).orderBy(turn("_span")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({f"_t_{n}": F.coalesce(F.sum(f"_t_{n}").over(before(turn)), F.lit(0.0)) for n, (_, turn) in sides.items()})
    per = per.withColumns({f"_l_{n}": F.min(F.col(f"_t_{n}") + F.col(f"_l_{n}")).over(before(turn)) for n, (_, turn) in sides.items()})
    out = out.join(per, [*keys, "_span"])
    total = lambda n: F.col(f"_t_{n}") + F.col(f"_s_{n}")
    out = out.withColumns({n: total(n) - F.least(F.col(f"_l_{n}"), F.col(f"_t_{n}") + F.col(f"_m_{n}")) for n in sides})
    return out.drop("_a", "_z", "_span", *[f"_{c}_{n}" for c in "smtl" for n in sides])


def cluster_mass(rows: DataFrame, keys: Keys, value: str, threshold: float) -> DataFrame:
    """(keys, max_mass): the largest sum over a run of what lies over ``threshold``; 0 without a run."""
    over = run_starts(rows.where(F.col(value) > threshold).select(*keys, "b", value), keys)
    mass = over.groupBy(*keys, "start").agg(F.sum(F.col(value) - threshold).alias("mass")).groupBy(*keys).agg(F.max("mass").alias("max_mass"))
    return rows.select(*keys).distinct().join(mass, list(keys), "left").withColumn("max_mass", F.coalesce("max_mass", F.lit(0.0)))


def min_event_filter(rows: DataFrame, keys: Keys, flag: str, least: int) -> DataFrame:
    """``kept``: the flag without runs of fewer than ``least`` rows."""
    return min_event(rows, keys, flag, least)


def valid_window(rows: DataFrame, keys: Keys, flag: str, least: int) -> DataFrame:
    """(keys, start, length) of the longest run of at least ``least`` rows, the earliest of equals."""
    found = runs(rows, keys, flag).where(F.col("length") >= least)
    best = found.groupBy(*keys).agg(F.max(F.struct("length", (-F.col("start")).alias("s"))).alias("m"))
    return best.select(*keys, (-F.col("m.s")).alias("start"), F.col("m.length").alias("length"))


def scan_max(rows: DataFrame, keys: Keys, value: str, widths: Sequence[int]) -> DataFrame:
    """(keys, scan_max): the largest root-width-scaled sum over trailing windows of any of ``widths``, whole ones only."""
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    whole = lambda n: F.when(F.count("*").over(w.rowsBetween(-(n - 1), 0)) == n, F.sum(value).over(w.rowsBetween(-(n - 1), 0)) / F.sqrt(F.lit(float(n))))
    out = spans.own(spans.haloed(rows.select(*keys, "b", value), max(widths) - 1, 0).withColumns({f"_w{n}": whole(n) for n in widths}))
    return out.groupBy(*keys).agg(F.greatest(*[F.max(f"_w{n}") for n in widths]).alias("scan_max"))


def llr_mask(real: DataFrame, null: DataFrame, channel: str, t_eff: float, halves: Sequence[int], quantile: float = 0.9, floor: float = 1.0) -> DataFrame:
    """(b, score, threshold, masked): pooled log-likelihood ratios of explained variance.

    ``real`` (channel, b, r2), ``null`` (channel, k, b, r2). Ratios are scored against the nulls of
    their channel and time; channels are weighted by their mean over their variance where positive;
    the largest of centred means of several widths is compared with the ``quantile`` of the nulls'
    largest, ``floor`` at least.
    """
    ratio = lambda r: F.lit(t_eff / 2) * F.log(1 / (1 - F.least(F.greatest(r, F.lit(-0.99)), F.lit(0.99))))
    n = null.select(channel, "k", "b", ratio(F.col("r2")).alias("l"))
    stats = n.groupBy(channel, "b").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))
    score = F.when(F.col("s") > 1e-12, (F.col("l") - F.col("m")) / F.col("s")).otherwise(0.0)
    rz = real.select(channel, "b", ratio(F.col("r2")).alias("l")).join(stats, [channel, "b"]).select(channel, F.lit(-1).alias("k"), "b", score.alias("z"))
    nz = n.join(stats, [channel, "b"]).select(channel, "k", "b", score.alias("z"))
    weight = rz.groupBy(channel).agg((F.greatest(F.avg("z"), F.lit(0.0)) / F.greatest(F.var_pop("z"), F.lit(1e-12))).alias("w"))
    total = weight.agg(F.sum("w").alias("total"))
    pooled = rz.union(nz).join(weight, channel).crossJoin(F.broadcast(total)).groupBy("k", "b").agg(F.sum(F.when(F.col("total") > 0, F.col("w") / F.col("total") * F.col("z")).otherwise(0.0)).alias("p"))
    w = Window.partitionBy("k", "_span").orderBy("b")
    smoothed = spans.own(spans.haloed(pooled, max(halves), max(halves)).withColumn("score", F.greatest(*[F.avg("p").over(w.rowsBetween(-h, h)) for h in halves])))
    cut = smoothed.where("k >= 0").groupBy("k").agg(F.max("score").alias("top")).agg(F.greatest(F.percentile("top", F.lit(quantile)), F.lit(floor)).alias("threshold"))
    return smoothed.where("k = -1").crossJoin(F.broadcast(cut)).select("b", "score", "threshold", (F.col("score") > F.col("threshold")).alias("masked"))


def llr_localization(real: DataFrame, null: DataFrame, channel: str, t_eff: float, halves: Sequence[int], least: int, quantile: float = 0.9, floor: float = 1.0, enough: tuple[int, int] = (20, 5)) -> DataFrame:
    """(b, score, threshold, masked, posterior): ``llr_mask`` without events of under ``least`` rows; the posterior is 1 inside.

    With fewer rows or draws than ``enough``, or no channel above its nulls, nothing is masked.
    """
    n = real.select("b").distinct().count(), null.select("k").distinct().count()
    out = llr_mask(real, null, channel, t_eff, halves, quantile, floor)
    held = F.col("masked") & F.lit(n[0] >= enough[0] and n[1] >= enough[1])
    kept = min_event(out.withColumns({"_one": F.lit(0), "_up": held}), ["_one"], "_up", least)
    return kept.select("b", "score", "threshold", F.col("kept").alias("masked"), F.col("kept").cast("double").alias("posterior"))


def masked_breakdown(rows: DataFrame, keys: Keys, value: str, mask: str) -> DataFrame:
    """(keys, inside, outside, difference): means of ``value`` where ``mask`` holds and where not."""
    m = F.col(mask)
    out = rows.groupBy(*keys).agg(F.avg(F.when(m, F.col(value))).alias("inside"), F.avg(F.when(~m, F.col(value))).alias("outside"))
    return out.withColumn("difference", F.col("inside") - F.col("outside"))
