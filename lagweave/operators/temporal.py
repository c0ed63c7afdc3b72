"""Time alignment, grids, as-of lookups, gaps, frames and lagged designs, as joins and windows.

Grids carry an integer index ``b``; joins are on it, never on a floating time. ``keys`` name the
columns of one stream. Windows run within a stream; sort order is always total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators import spans

Keys = Sequence[str]


def stream_summary(samples: DataFrame, keys: Keys) -> DataFrame:
    """Samples, duration and mean rate of each stream."""
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration"))
    return out.withColumn("rate", F.when(F.col("duration") > 0, F.col("n") / F.col("duration")))


def align_overlap(samples: DataFrame, session: str, stream: str) -> DataFrame:
    """Samples inside the time that all streams of a session share, with time from its start.

    Sessions whose streams don't overlap have no rows. Bounds come from a two-level aggregate; the
    samples are scanned once more and filtered by a join with one row a session.
    """
    spans = samples.groupBy(session, stream).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    shared = spans.groupBy(session).agg(F.max("a").alias("t_start"), F.min("b").alias("t_end")).where("t_start < t_end")
    return samples.join(shared, session).where(F.col("t").between(F.col("t_start"), F.col("t_end"))).withColumn("t", F.col("t") - F.col("t_start"))


def grid(samples: DataFrame, keys: Keys, width: float) -> DataFrame:
    """(keys, b, x, n, valid): means in bins of ``width`` seconds, every bin from 0 to the last one of all.

    Empty bins have x null and valid false. Samples are aggregated before anything is expanded.
    """
    binned = samples.groupBy(*keys, F.floor(F.col("t") / width).cast("int").alias("b")).agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    last = binned.agg(F.max("b").alias("last"))
    streams = binned.select(*keys).distinct().crossJoin(F.broadcast(last)).select(*keys, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("b"))
    return streams.join(binned, [*keys, "b"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("valid", F.col("n") > 0)


def bin_validity(samples: DataFrame, keys: Keys, n_bins: int | None = None, width: float = 1.0) -> DataFrame:
    """(keys, b, frac): share of valid samples in each bin, empty 0.

    ``n_bins`` bins, later samples counted in the last; without it as many as reach the last sample of all.
    """
    b = F.floor(F.col("t") / width).cast("int")
    got = samples.groupBy(*keys, (b if n_bins is None else F.least(b, F.lit(n_bins - 1))).alias("b")).agg(F.avg(F.col("valid").cast("double")).alias("frac"))
    last = samples.agg((F.max(b) if n_bins is None else F.lit(n_bins - 1)).alias("last"))
    streams = samples.select(*keys).distinct().crossJoin(F.broadcast(last)).select(*keys, F.explode(F.expr("sequence(0, last)")).alias("b"))
    return streams.join(got, [*keys, "b"], "left").withColumn("frac", F.coalesce("frac", F.lit(0.0)))


def zscore_clip(rows: DataFrame, keys: Keys, value: str = "x", clip: float = 10.0) -> DataFrame:
    """``z``: value less the mean over the standard deviation (population) of its stream's valid rows.

    A deviation of 1e-8 or less gives 0; invalid rows give 0. Statistics are one row a stream.
    """
    stats = rows.where("valid").groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.least(F.greatest((F.col(value) - F.col("_m")) / F.col("_s"), F.lit(-clip)), F.lit(clip))
    return rows.join(stats, list(keys), "left").withColumn("z", F.when(F.col("valid") & (F.col("_s") > 1e-8), z).otherwise(0.0)).drop("_m", "_s")


def activity(rows: DataFrame, keys: Keys, width: int, value: str = "z") -> DataFrame:
    """``activity``: mean of the absolute value over the trailing ``width`` rows."""
    w = Window.partitionBy(*keys, "_span").orderBy("b").rowsBetween(-(width - 1), 0)
    return spans.own(spans.haloed(rows, width - 1, 0).withColumn("activity", F.avg(F.abs(value)).over(w)))


def derivative(rows: DataFrame, keys: Keys, value: str = "x") -> DataFrame:
    """``dx``: difference from the row before, 0 at the start."""
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    return spans.own(spans.haloed(rows, 1, 0).withColumn("dx", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))))


def smooth(rows: DataFrame, keys: Keys, half: int, value: str = "x", out: str = "smooth") -> DataFrame:
    """Centred moving mean over 2 * ``half`` + 1 rows, shorter at the ends."""
    w = Window.partitionBy(*keys, "_span").orderBy("b").rowsBetween(-half, half)
    return spans.own(spans.haloed(rows, half, half).withColumn(out, F.avg(value).over(w)))


def run_starts(rows: DataFrame, keys: Keys) -> DataFrame:
    """``rows`` with ``start``: the first ``b`` of the run of consecutive ones that each lies in, carried over spans."""
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    new = F.when(F.lag("b").over(w) == F.col("b") - 1, None).otherwise(F.col("b"))
    begun = spans.own(spans.haloed(rows, 1, 0).withColumn("_new", new))
    return spans.running(begun, keys, ["b"], {"start": ("max", F.col("_new"))}).drop("_new")


def runs(rows: DataFrame, keys: Keys, flag: str) -> DataFrame:
    """(keys, start, length) of the maximal runs of consecutive ``b`` on which ``flag`` holds."""
    return run_starts(rows.where(flag).select(*keys, "b"), keys).groupBy(*keys, "start").agg(F.count("*").alias("length"))


def run_lengths(rows: DataFrame, keys: Keys, flag: str, out: str = "run_length") -> DataFrame:
    """Each row with the length of the run of equal ``flag`` that it lies in."""
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    turned = F.when(F.col(flag) == F.lag(flag).over(w), 0).otherwise(1)
    marked = spans.own(spans.haloed(rows, 1, 0).withColumn("_turn", turned))
    marked = spans.running(marked, keys, ["b"], {"_run": ("sum", F.col("_turn"))})
    return marked.join(marked.groupBy(*keys, "_run").agg(F.count("*").alias(out)), [*keys, "_run"]).drop("_turn", "_run")


def min_event(rows: DataFrame, keys: Keys, flag: str, least: int) -> DataFrame:
    """``kept``: the flag without runs of fewer than ``least`` rows, by spans with ``least`` rows around.

    A row stays if any ``least`` consecutive rows that hold it all have the flag. ``b`` has no gaps.
    """
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    ahead = F.min(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(w.rowsBetween(0, least - 1))
    whole = F.count("*").over(w.rowsBetween(0, least - 1)) == least
    out = spans.haloed(rows, least - 1, least - 1).withColumn("_begins", F.when(whole & (ahead == 1), 1).otherwise(0))
    return spans.own(out.withColumn("kept", F.max("_begins").over(w.rowsBetween(-(least - 1), 0)) == 1)).drop("_begins")


def fill_short_gaps(rows: DataFrame, keys: Keys, longest: int, value: str = "x") -> DataFrame:
    """``filled``: in gaps of at most ``longest`` rows between two valid rows, the line between those."""
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    past, future = w.rowsBetween(-longest, 0), w.rowsBetween(0, longest)  # as far as a short gap reaches
    at = F.when(F.col("valid"), F.struct(F.col("b").alias("b"), F.col(value).alias("x")))
    out = spans.own(spans.haloed(rows, longest, longest).withColumns({"_p": F.last(at, True).over(past), "_q": F.first(at, True).over(future)}))
    part = (F.col("b") - F.col("_p.b")) / (F.col("_q.b") - F.col("_p.b"))
    line = F.col("_p.x") + part * (F.col("_q.x") - F.col("_p.x"))
    gap = F.col("_q.b") - F.col("_p.b") - 1
    return out.withColumn("filled", F.when(F.col("valid"), F.col(value)).when(gap <= longest, line)).drop("_p", "_q")


def asof(times: DataFrame, samples: DataFrame, keys: Keys, value: str = "x", width: float = 86400.0) -> DataFrame:
    """``times`` (keys, t) with the samples before (or at) and after (or at) each, as t0, x0, t1, x1.

    One sorted pass over the union of both sides by span of ``width``, with the nearest samples of other
    spans carried over: linear, without a range join, and no task orders a stream. Of samples at one
    time the one of the largest value counts.
    """
    keyed = samples.groupBy(*keys, "t").agg(F.max(value).alias("_x"))
    both = keyed.select(*keys, "t", F.col("_x"), F.lit(1).alias("_own")).union(times.select(*keys, "t").distinct().select(*keys, "t", F.lit(None).cast("double"), F.lit(0)))
    at = F.when(F.col("_own") == 1, F.struct(F.col("t").alias("t"), F.col("_x").alias("x")))
    past = spans.running(both.withColumn("_turn", 1 - F.col("_own")), keys, ["t", "_turn"], {"_p": ("max", at)}, width, "t")
    found = spans.running(past.withColumn("_turn", F.col("_own")), keys, ["t", "_turn"], {"_q": ("min", at)}, width, "t", later=True).where("_own = 0")
    return found.select(*keys, "t", F.col("_p.t").alias("t0"), F.col("_p.x").alias("x0"), F.col("_q.t").alias("t1"), F.col("_q.x").alias("x1"))


def asof_next(found: DataFrame) -> DataFrame:
    """The next sample; past the last one, the last."""
    return found.withColumn("x", F.coalesce("x1", "x0"))


def asof_nearest(found: DataFrame, tolerance: float) -> DataFrame:
    """The nearest sample, the later of two as near; null unless nearer than ``tolerance``."""
    before, after = F.col("t") - F.col("t0"), F.col("t1") - F.col("t")
    gap = F.least(F.coalesce(before, F.lit(float("inf"))), F.coalesce(after, F.lit(float("inf"))))
    x = F.when(F.coalesce(after, F.lit(float("inf"))) <= F.coalesce(before, F.lit(float("inf"))), F.col("x1")).otherwise(F.col("x0"))
    return found.withColumn("gap", gap).withColumn("x", F.when(gap < tolerance, x)).withColumn("gap", F.when(gap < float("inf"), gap))


def asof_lerp(found: DataFrame) -> DataFrame:
    """Linear interpolation, held at the ends."""
    part = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    return found.withColumn("x", F.coalesce(F.col("x0") + part * (F.col("x1") - F.col("x0")), "x0", "x1"))


def lag_convolution(rows: DataFrame, keys: Keys, basis: Sequence[Sequence[float]], value: str = "z") -> DataFrame:
    """(keys, b, c0, c1, ...): causal convolution with each basis column, zero before the start.

    Each lag is a ``lag`` of one window over spans with a halo, so there is one shuffle.
    """
    weights = {f"c{j}": {s: float(basis[s][j]) for s in range(len(basis))} for j in range(len(basis[0]))}
    return spans.lag_sums(rows, keys, value, weights).select(*keys, "b", *weights)


def ar_terms(rows: DataFrame, keys: Keys, order: int, value: str = "z") -> DataFrame:
    """(keys, b, value, ar1, ar2, ...): the values before, 0 before the start."""
    w = Window.partitionBy(*keys, "_span").orderBy("b")
    lagged = {f"ar{k}": F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) for k in range(1, order + 1)}
    return spans.own(spans.haloed(rows, order, 0).withColumns(lagged)).select(*keys, "b", value, *lagged)
