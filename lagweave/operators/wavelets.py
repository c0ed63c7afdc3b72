"""Wavelets, decimation, regions, phases and coherence over time, as sums of lags by span.

A wavelet ends four deviations from its centre, so its transform needs a halo and no whole stream.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.operators import spans
from lagweave.operators.temporal import Keys, min_event
from lagweave.sources.shared import written


def morlet(freq: float, rate: float, cycles: float) -> dict[int, complex]:
    """Lag -> weight of a complex Morlet wavelet, scaled to a sum of sizes of 1."""
    sd = cycles / (2 * np.pi * freq)
    reach = max(1, int(np.ceil(4 * sd * rate)))
    t = np.arange(-reach, reach + 1) / rate
    w = np.exp(2j * np.pi * freq * t - t**2 / (2 * sd**2))
    w = w / np.abs(w).sum()
    return {int(k): complex(v) for k, v in zip(range(-reach, reach + 1), w)}


def gaussian(sd: float) -> dict[int, float]:
    """Lag -> weight of a Gaussian of ``sd`` rows, scaled to a sum of 1."""
    reach = max(1, int(np.ceil(4 * sd)))
    k = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (k / sd) ** 2)
    return {int(i): float(v) for i, v in zip(k, w / w.sum())}


def low_pass(factor: int) -> dict[int, float]:
    """Lag -> weight of a Hamming-windowed sinc that passes below half the rate over ``factor``."""
    reach = 4 * factor
    k = np.arange(-reach, reach + 1)
    w = np.sinc(k / factor) * (0.54 + 0.46 * np.cos(np.pi * k / reach))
    return {int(i): float(v) for i, v in zip(k, w / w.sum())}


def analytic(rows: DataFrame, keys: Keys, value: str, rate: float, freqs: Sequence[float], cycles: float = 5.0) -> DataFrame:
    """``rows`` with re0, im0, re1, ...: the Morlet transform at each frequency, zeros outside the stream."""
    weights = {}
    for i, f in enumerate(freqs):
        w = morlet(f, rate, cycles)
        weights |= {f"re{i}": {k: v.real for k, v in w.items()}, f"im{i}": {k: v.imag for k, v in w.items()}}
    return spans.lag_sums(rows, keys, value, weights)


def morlet_power(rows: DataFrame, keys: Keys, value: str, rate: float, freqs: Sequence[float], cycles: float = 5.0) -> DataFrame:
    """(keys, b, power array<double>): power of the complex Morlet transform at each frequency."""
    out = analytic(rows, keys, value, rate, freqs, cycles)
    return out.select(*keys, "b", F.array(*[F.col(f"re{i}") * F.col(f"re{i}") + F.col(f"im{i}") * F.col(f"im{i}") for i in range(len(freqs))]).alias("power"))


def smoothed(rows: DataFrame, keys: Keys, value: str, sd: float, out: str = "smooth") -> DataFrame:
    """``rows`` with the value smoothed by a Gaussian of ``sd`` rows, weighed anew at the ends."""
    w = gaussian(sd)
    both = spans.lag_sums(rows.withColumn("_one", F.lit(1.0)), keys, value, {"_s": w})
    both = spans.lag_sums(both, keys, "_one", {"_n": w})
    return both.withColumn(out, F.col("_s") / F.col("_n")).drop("_one", "_s", "_n")


def decimated(rows: DataFrame, keys: Keys, value: str, factor: int) -> DataFrame:
    """(keys, b, value, valid): every ``factor``-th row after a low pass; validity is that of the row."""
    out = spans.lag_sums(rows, keys, value, {"_low": low_pass(factor)}).where(F.col("b") % factor == 0)
    return out.select(*keys, F.floor(F.col("b") / factor).cast("int").alias("b"), F.col("_low").alias(value), "valid")


def regions(values: Column, valid: Column, groups: Sequence[Sequence[int]]) -> Column:
    """array<struct<x, valid>>: of each group of channels the mean of its valid ones; valid if at least half are."""
    out = []
    for group in groups:
        ok = [F.coalesce(valid[c], F.lit(False)) for c in group]
        n = sum((v.cast("int") for v in ok), F.lit(0))
        total = sum((F.when(v, values[c].cast("double")).otherwise(0.0) for c, v in zip(group, ok)), F.lit(0.0))
        out.append(F.struct(F.when(n > 0, total / n).otherwise(0.0).alias("x"), (n >= -(-len(group) // 2)).alias("valid")))
    return F.array(*out)


def phase_features(re1: Column, im1: Column, re2: Column, im2: Column) -> tuple[Column, Column]:
    """(cos, sin) of the phase difference of two analytic values."""
    size = F.greatest(F.sqrt((re1 * re1 + im1 * im1) * (re2 * re2 + im2 * im2)), F.lit(1e-30))
    return (re1 * re2 + im1 * im2) / size, (im1 * re2 - re1 * im2) / size


def _centred(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The convolution, as long as ``x`` and without delay."""
    return np.convolve(x, w)[len(w) // 2 : len(w) // 2 + len(x)]


def _canonical(t: np.ndarray, bell: np.ndarray, p: int, regular: float, every: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Largest canonical coherence of the first ``p`` rows of transforms ``t`` (channel, time) and the others, at some times."""
    n = len(t)
    s = np.empty((len(t[0][every]), n, n), complex)
    for a in range(n):
        for b in range(a, n):
            s[:, a, b] = _centred(np.conj(t[a]) * t[b], bell)[every]
            s[:, b, a] = np.conj(s[:, a, b])
    if n == 2:
        return np.abs(s[:, 0, 1]) / np.sqrt(np.maximum((s[:, 0, 0] * s[:, 1, 1]).real, 1e-20))

    def root(s: np.ndarray) -> np.ndarray:
        s = s + regular * (np.trace(s, axis1=1, axis2=2).real / s.shape[1])[:, None, None] * np.eye(s.shape[1])
        size, vectors = np.linalg.eigh(s)
        return (vectors / np.sqrt(np.maximum(size, 1e-20))[:, None, :]) @ vectors.conj().transpose(0, 2, 1)

    return np.minimum(np.linalg.svd(root(s[:, :p, :p]) @ s[:, :p, p:] @ root(s[:, p:, p:]), compute_uv=False)[:, 0], 1.0)


def canonical_coherence(rows: DataFrame, keys: Keys, left: Sequence[str], right: Sequence[str], rate: float, freqs: Sequence[float], cycles: float = 5.0, smooth_cycles: float = 5.0, regular: float = 1e-4) -> DataFrame:
    """(keys, b, coherence): mean over ``freqs`` of the largest canonical coherence of two sets of channels.

    ``rows`` (keys, b, channels): products of the wavelet transforms are smoothed by a Gaussian of
    ``smooth_cycles`` periods. Spans are worked on their own, with as many rows around them as the longest
    wavelet and Gaussian reach; outside the stream all is 0.
    """
    channels = [*left, *right]
    waves = [np.array(list(morlet(f, rate, cycles).values())) for f in freqs]
    bells = [np.array(list(gaussian(smooth_cycles * rate / f / 6).values())) for f in freqs]
    halo = max(len(w) // 2 + len(g) // 2 for w, g in zip(waves, bells))
    p = len(left)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        x = np.nan_to_num(frame[channels].to_numpy(float)).T
        total = sum(_canonical(np.stack([_centred(v, w) for v in x]), g, p, regular) for w, g in zip(waves, bells))
        return frame[[*keys, "b"]].assign(coherence=total / len(freqs))[frame["_own"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "b").schema)
    spread = spans.haloed(rows.select(*keys, "b", *channels), halo, halo)
    return spread.groupBy(*keys, "_span").applyInPandas(work, f"{kinds}, coherence double")


def coherence_mask(real: DataFrame, null: DataFrame, keys: Keys, value: str, share: float = 0.1, least: int = 2) -> DataFrame:
    """(keys, b, z, posterior, masked): where a series exceeds what its shifted copies reach.

    ``null`` has the draw ``k``. Values are scored by mean and deviation of the nulls of their stream; the
    threshold is the 1 - ``share`` quantile of the nulls' largest scores, 1 at least; runs of fewer than
    ``least`` rows go. The posterior is the logistic of twice the distance from the threshold.
    """
    stats = null.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    tops = null.join(stats, list(keys)).groupBy(*keys, "k").agg(F.max(z).alias("top")).groupBy(*keys).agg(F.greatest(F.percentile("top", F.lit(1 - share)), F.lit(1.0)).alias("_cut"))
    out = real.join(stats, list(keys)).join(tops, list(keys)).withColumn("z", z)
    out = out.withColumns({"posterior": 1 / (1 + F.exp(-2 * (F.col("z") - F.col("_cut")))), "_up": F.col("z") > F.col("_cut")})
    return min_event(out, keys, "_up", least).select(*keys, "b", "z", "posterior", F.col("kept").alias("masked"))


def transformed(rows: DataFrame, keys: Keys, channels: Sequence[str], rate: float, freqs: Sequence[float], cycles: float = 5.0) -> DataFrame:
    """(keys, b, w): wavelet transforms of the channels at all frequencies, real and imaginary parts by frequency and channel."""
    waves = [np.array(list(morlet(f, rate, cycles).values())) for f in freqs]
    halo = max(len(w) // 2 for w in waves)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        x = np.nan_to_num(frame[list(channels)].to_numpy(float)).T
        t = np.stack([_centred(v, w) for w in waves for v in x], 1)[frame["_own"].to_numpy()]
        out = frame.loc[frame["_own"], [*keys, "b"]]
        return out.assign(w=pd.Series(list(np.concatenate([t.real, t.imag], 1)), out.index, object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "b").schema)
    return spans.haloed(rows.select(*keys, "b", *channels), halo, halo).groupBy(*keys, "_span").applyInPandas(work, f"{kinds}, w array<double>")


def coherence_localization(
    rows: DataFrame, keys: Keys, left: Sequence[str], right: Sequence[str], rate: float, freqs: Sequence[float], n_shifts: int = 100, every: int = 1, cycles: float = 5.0, smooth_cycles: float = 5.0,
    regular: float = 1e-4, share: float = 0.1, least: int = 2, min_shift: float = 0.1, size: int = 512,
) -> DataFrame:
    """(keys, b, z, posterior, masked): when two people's channels are coherent, on every ``every``-th row.

    ``rows`` (keys, b from 0 without gaps, channels). Each side is transformed once and stored. The left transform
    moves round by ``n_shifts`` even shifts, ``min_shift`` of the stream at least, against the still right one: as
    shifting the signal does, but for the reach of a wavelet at the seam. A span meets all its draws, so each time
    is scored against them where it stands, and of the nulls only the largest score of a span and draw leaves it.
    The mask is that of ``coherence_mask``.
    """
    bells = [np.array(list(gaussian(smooth_cycles * rate / f / 6).values())) for f in freqs]
    halo, p, n_freqs = max(len(g) // 2 for g in bells), len(left), len(freqs)
    ends = rows.groupBy(*keys).agg((F.max("b") + 1).cast("int").alias("_n"))
    one, two = (written(transformed(rows, keys, side, rate, freqs, cycles)) for side in (left, right))
    low = F.greatest(F.floor(F.col("_n") * min_shift), F.lit(1))
    step = F.greatest(F.floor((F.col("_n") - 2 * low) / max(1, n_shifts)), F.lit(1))
    moved = one.join(ends, list(keys)).withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(n_shifts - 1))))
    moved = moved.select(*keys, "k", F.pmod(F.col("b") + F.when(F.col("k") < 0, 0).otherwise(low + F.col("k") * step), F.col("_n")).cast("int").alias("b"), "w")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*keys, "b", "k", "v"])
        b = b.sort_values("b")
        times, mine = b["b"].to_numpy(), b["_own"].to_numpy() & (b["b"].to_numpy() % every == 0)
        still, values = unpacked(b["w"], len(right)), {}
        for k, part in a.groupby("k"):
            turned = unpacked(part.sort_values("b")["w"], p)
            values[k] = sum(_canonical(np.concatenate([turned[f], still[f]]), bells[f], p, regular, mine) for f in range(n_freqs)) / n_freqs
        null = np.stack([v for k, v in sorted(values.items()) if k >= 0])
        mean, spread = null.mean(0), np.maximum(null.std(0), 1e-8)
        out = pd.DataFrame({"b": times[mine], "k": -1, "v": (values[-1] - mean) / spread})
        if len(out):
            tops = pd.DataFrame({"b": -1, "k": np.arange(len(null)), "v": ((null - mean) / spread).max(1)})
            out = pd.concat([out, tops])
        return out.assign(**{c: a[c].iloc[0] for c in keys})[[*keys, "b", "k", "v"]]

    def unpacked(w: pd.Series, n: int) -> np.ndarray:
        """(frequency, channel, time)."""
        t = np.stack(w.to_numpy())
        half = t.shape[1] // 2
        return (t[:, :half] + 1j * t[:, half:]).T.reshape(n_freqs, n, len(t))

    by = [*keys, "_span"]
    parts = spans.haloed(moved, halo, halo, size).groupBy(*by).cogroup(spans.haloed(two, halo, halo, size).groupBy(*by)).applyInPandas(work, f"{kinds}, b int, k int, v double")
    parts = written(parts)
    tops = parts.where("k >= 0").groupBy(*keys, "k").agg(F.max("v").alias("top")).groupBy(*keys).agg(F.greatest(F.percentile("top", F.lit(1 - share)), F.lit(1.0)).alias("_cut"))
    out = parts.where("k < 0").join(tops, list(keys)).select(*keys, (F.col("b") / every).cast("int").alias("b"), F.col("v").alias("z"), "_cut")
    out = out.withColumns({"posterior": 1 / (1 + F.exp(-2 * (F.col("z") - F.col("_cut")))), "_up": F.col("z") > F.col("_cut")})
    return min_event(out, keys, "_up", least).select(*keys, (F.col("b") * every).cast("int").alias("b"), "z", "posterior", F.col("kept").alias("masked"))
