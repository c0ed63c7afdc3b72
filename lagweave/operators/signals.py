"""Signal features: filters, spectra, coherence, heart beats and pose geometry.

Window membership is an explode of each sample to the windows it lies in, so long recordings are
shared out by (stream, window) or (stream, chunk with halo), never one task a recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators import spans
from lagweave.operators.temporal import Keys


def _schema(rows: DataFrame, keys: Keys) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)


def biquad(kind: str, freq: float, rate: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """(numerator, denominator) of a second-order low-pass, high-pass or notch section."""
    w = 2 * np.pi * freq / rate
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    b = {"low": np.array([(1 - c) / 2, 1 - c, (1 - c) / 2]), "high": np.array([(1 + c) / 2, -1 - c, (1 + c) / 2]), "notch": np.array([1, -2 * c, 1.0])}[kind]
    a = np.array([1 + alpha, -2 * c, 1 - alpha])
    return b / a[0], a / a[0]


def butterworth(low: float, high: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections of a fourth-order Butterworth band: two high-pass and two low-pass sections."""
    qs = [1 / (2 * np.cos(np.pi * k / 8)) for k in (1, 3)]
    return [biquad("high", low, rate, q) for q in qs] + [biquad("low", high, rate, q) for q in qs]


def zero_phase(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], pad: int) -> np.ndarray:
    """Sections run forwards and backwards over ``x`` with odd extension at both ends."""
    if len(x) < 2:
        return x
    pad = min(pad, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            s1 = s2 = 0.0
            out = np.empty_like(y)
            for i, v in enumerate(y.tolist()):
                o = b[0] * v + s1
                s1, s2 = b[1] * v - a[1] * o + s2, b[2] * v - a[2] * o
                out[i] = o
            y = out
        y = y[::-1]
    return y[pad : pad + len(x)]


def filtered(rows: DataFrame, keys: Keys, value: str, sections: list[tuple[np.ndarray, np.ndarray]], chunk: int, halo: int) -> DataFrame:
    """(keys, b, filtered): zero-phase filtering in chunks of ``chunk`` rows, each with ``halo`` rows around it.

    A chunk is one task's group whatever the recording's length; the halo is cut off afterwards.
    """
    at = F.floor(F.col("b") / chunk)
    near = F.array_distinct(F.array(at, F.floor((F.col("b") - halo) / chunk), F.floor((F.col("b") + halo) / chunk)))
    dealt = rows.select(*keys, "b", value).withColumn("_chunk", F.explode(near))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        y = zero_phase(np.nan_to_num(frame[value].to_numpy(float)), sections, halo)
        mine = (frame["b"] // chunk == frame["_chunk"]).to_numpy()
        return pd.DataFrame({**{k: frame[k][mine] for k in keys}, "b": frame["b"][mine], "filtered": y[mine]})

    return dealt.groupBy(*keys, "_chunk").applyInPandas(run, f"{_schema(rows, keys)}, b int, filtered double")


def windows(rows: DataFrame, width: int, step: int) -> DataFrame:
    """``rows`` once for each window (start w * ``step``, ``width`` rows long) that they lie in; none starts before 0."""
    first = F.greatest(F.lit(0), F.ceil((F.col("b") - width + 1) / step)).cast("int")
    return rows.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("b") / step).cast("int"))))


def spectra(rows: DataFrame, keys: Keys, values: Sequence[str], width: int, step: int, rate: float, work: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, float]], out: Sequence[str]) -> DataFrame:
    """(keys, w, out): ``work`` on Welch spectra of each whole window.

    Half-width segments with half overlap, means taken out, periodic Hann window.
    """
    n = width // 2
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    freqs = np.fft.rfftfreq(n, 1 / rate)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        if len(frame) < width:
            return pd.DataFrame({k: pd.Series(dtype=frame[k].dtype) for k in (*keys, "w")} | {c: pd.Series(dtype=float) for c in out})
        found = {}
        for c in values:
            x = np.nan_to_num(frame[c].to_numpy(float))
            cuts = np.stack([x[i : i + n] for i in range(0, width - n + 1, n // 2)])
            found[c] = np.fft.rfft((cuts - cuts.mean(1, keepdims=True)) * hann, axis=1)
        got = work(found, freqs)
        return pd.DataFrame({**{k: frame[k].iloc[:1].to_numpy() for k in (*keys, "w")}, **{c: [got[c]] for c in out}})

    dealt = windows(rows.select(*keys, "b", *values), width, step)
    return dealt.groupBy(*keys, "w").applyInPandas(run, f"{_schema(rows, keys)}, w int, " + ", ".join(f"{c} double" for c in out))


def band_power(rows: DataFrame, keys: Keys, value: str, width: int, step: int, rate: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(keys, w, one column a band): summed Welch power in each band, ends included."""

    def work(f: dict[str, np.ndarray], freqs: np.ndarray) -> dict[str, float]:
        p = (np.abs(f[value]) ** 2).mean(0)
        return {b: float(p[(freqs >= lo) & (freqs <= hi)].sum()) for b, (lo, hi) in bands.items()}

    return spectra(rows, keys, [value], width, step, rate, work, list(bands))


def band_coherence(rows: DataFrame, keys: Keys, x: str, y: str, width: int, step: int, rate: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(keys, w, <band>_msc, <band>_imcoh): mean squared and imaginary coherence of two channels by band."""

    def work(f: dict[str, np.ndarray], freqs: np.ndarray) -> dict[str, float]:
        cross = (np.conj(f[x]) * f[y]).mean(0)
        power = np.maximum((np.abs(f[x]) ** 2).mean(0) * (np.abs(f[y]) ** 2).mean(0), 1e-20)
        inside = {b: (freqs >= lo) & (freqs <= hi) for b, (lo, hi) in bands.items()}
        msc, im = np.abs(cross) ** 2 / power, np.abs(cross.imag) / np.sqrt(power)
        return {f"{b}_{n}": float(v[m].mean()) if m.any() else 0.0 for b, m in inside.items() for n, v in (("msc", msc), ("imcoh", im))}

    return spectra(rows, keys, [x, y], width, step, rate, work, [f"{b}_{n}" for b in bands for n in ("msc", "imcoh")])


def beats(rows: DataFrame, keys: Keys, value: str, height_sd: float = 0.5, distance_s: float = 0.4, span_s: float = 86400.0) -> DataFrame:
    """(keys, t, ibi): R peaks and the interval since the peak before, clipped to 0.3 to 2 s.

    A peak is a local maximum over ``height_sd`` deviations and the highest within ``distance_s`` on
    either side; rows (keys, t, value). Samples are worked by span of ``span_s`` with what surrounds it.
    """
    by = Window.partitionBy(*keys, "_span").orderBy("t")
    around = f"OVER (PARTITION BY {', '.join(keys)}, _span ORDER BY t RANGE BETWEEN {distance_s!r}D PRECEDING AND {distance_s!r}D FOLLOWING)"
    stats = rows.groupBy(*keys).agg((F.avg(value) + height_sd * F.stddev_pop(value)).alias("_cut"))
    place = F.struct("t", value)
    neighbours = spans.running(rows.select(*keys, "t", value), keys, ["t"], {"_p": ("max", place)}, span_s, "t", inclusive=False)
    neighbours = spans.running(neighbours, keys, ["t"], {"_n": ("min", place)}, span_s, "t", inclusive=False, later=True)
    marked = spans.own(spans.haloed(neighbours, distance_s, distance_s, span_s, "t").withColumn("_top", F.expr(f"max({value}) {around}"))).join(stats, list(keys))
    peaks = marked.where((F.col(value) >= F.col("_cut")) & (F.col(value) == F.col("_top")) & (F.col(value) > F.col(f"_p.{value}")) & (F.col(value) >= F.col(f"_n.{value}"))).select(*keys, "t")
    gap = F.col("t") - F.col("_before")
    found = spans.running(peaks, keys, ["t"], {"_before": ("max", F.col("t"))}, span_s, "t", inclusive=False)
    return found.select(*keys, "t", F.when(gap.isNotNull(), F.least(F.greatest(gap, F.lit(0.3)), F.lit(2.0))).alias("ibi"))


def heart_rate(peaks: DataFrame, keys: Keys, window_s: float) -> DataFrame:
    """(keys, t, hr, rmssd, sdnn) over the trailing ``window_s`` at each beat, by span with what lies before it."""
    span_s = max(10 * window_s, 86400.0)
    back = f"OVER (PARTITION BY {', '.join(keys)}, _span ORDER BY t RANGE BETWEEN {window_s!r}D PRECEDING AND CURRENT ROW)"
    step = spans.running(peaks.select(*keys, "t", "ibi"), keys, ["t"], {"_p": ("max", F.struct("t", "ibi"))}, span_s, "t", inclusive=False).withColumn("_d", F.col("ibi") - F.col("_p.ibi"))
    step = spans.haloed(step, window_s, 0, span_s, "t")
    return spans.own(step.withColumns({"hr": F.expr(f"60 / avg(ibi) {back}"), "rmssd": F.expr(f"sqrt(avg(_d * _d) {back})"), "sdnn": F.expr(f"stddev_pop(ibi) {back}")})).select(*keys, "t", "hr", "rmssd", "sdnn")


def engagement(rows: DataFrame, keys: Keys, value: str, width: int, step: int, theta: tuple[int, int], alpha: tuple[int, int], beta: tuple[int, int]) -> DataFrame:
    """(keys, w, engagement): power in ``beta`` over that in ``alpha`` and ``theta``, ranges of cycles a window.

    The Fourier sums of whole windows are map-side combined aggregates.
    """
    i = F.col("b") - F.col("w") * step

    def power(k: int) -> Column:
        turn = F.lit(2 * np.pi * k / width) * i
        return F.pow(F.sum(F.col(value) * F.cos(turn)), 2) + F.pow(F.sum(F.col(value) * F.sin(turn)), 2)

    band = lambda r: sum((F.col(f"_p{k}") for k in range(r[0], r[1] + 1)), F.lit(0.0))
    every = sorted({k for r in (theta, alpha, beta) for k in range(r[0], r[1] + 1)})
    sums = windows(rows.select(*keys, "b", value), width, step).groupBy(*keys, "w").agg(F.count("*").alias("_n"), *[power(k).alias(f"_p{k}") for k in every]).where(F.col("_n") == width)
    return sums.select(*keys, "w", (band(beta) / (band(alpha) + band(theta) + 1e-20)).alias("engagement"))


def phase_and_bursts(rows: DataFrame, keys: Keys, re: str, im: str, width: int, step: int, expected: float) -> DataFrame:
    """(keys, w, cos, sin, burst): circular mean phase of an analytic signal by window, and its share of bursts.

    A burst is power over the 95 % point of noise of the ``expected`` power, -2 ln 0.05 times it.
    """
    size = F.greatest(F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im)), F.lit(1e-30))
    burst = (F.col(re) * F.col(re) + F.col(im) * F.col(im) > expected * -2 * float(np.log(0.05))).cast("int")
    out = windows(rows.select(*keys, "b", re, im), width, step).groupBy(*keys, "w").agg(F.atan2(F.avg(F.col(im) / size), F.avg(F.col(re) / size)).alias("_phase"), F.avg(burst).alias("burst"))
    return out.select(*keys, "w", F.cos("_phase").alias("cos"), F.sin("_phase").alias("sin"), "burst")


def centroid(points: Column, axes: int) -> Column:
    """Mean of an array of points."""
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k])
    return F.array(*[total(k) / F.size(points) for k in range(axes)])


def extent(points: Column, axes: int) -> Column:
    """Length of the diagonal of the box around an array of points."""
    side = lambda k: F.array_max(F.transform(points, lambda p: p[k])) - F.array_min(F.transform(points, lambda p: p[k]))
    return F.sqrt(sum((side(k) * side(k) for k in range(axes)), F.lit(0.0)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at ``b`` between the points ``a`` and ``c``."""
    u, v = F.zip_with(a, b, lambda x, y: x - y), F.zip_with(c, b, lambda x, y: x - y)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.least(F.greatest(dot(u, v) / (F.sqrt(dot(u, u)) * F.sqrt(dot(v, v)) + 1e-8), F.lit(-1.0)), F.lit(1.0)))


def principal_components(vectors: DataFrame, vector: str, n_channels: int, k: int) -> np.ndarray:
    """(k, channels) loadings from second moments summed per task; the largest loading of each is positive.

    A covariance is over the rows that have both channels.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    some = rows.first()
    near = np.zeros(n_channels)  # any row of the data as origin keeps the moments small
    if some is not None:
        near[: len(some["v"])] = [x or 0.0 for x in some["v"][:n_channels]]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = (np.zeros((n_channels, n_channels)) for _ in range(3))
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy()
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x = np.full((len(sizes), n_channels), np.nan)
            row, inside = np.repeat(np.arange(len(sizes)), sizes), at < n_channels
            x[row[inside], at[inside]] = batch.column(0).flatten().to_numpy(zero_copy_only=False)[inside]
            have = (~np.isnan(x)).astype(float)
            x = np.where(have > 0, x - near, 0.0)
            n, s, p = n + have.T @ have, s + x.T @ have, p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_channels**2)), *(pa.array(m.ravel()) for m in (n, s, p))], names=["at", "n", "s", "p"])

    cov = np.zeros(n_channels**2)
    n, s, p = cov.copy(), cov.copy(), cov.copy()
    for r in rows.mapInArrow(moments, "at long, n double, s double, p double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("p").alias("p")).collect():  # a row a pair of channels
        n[r["at"]], s[r["at"]], p[r["at"]] = r["n"], r["s"], r["p"]
    n, s, p = (m.reshape(n_channels, n_channels) for m in (np.maximum(n, 1), s, p))
    cov = p / n - s * s.T / n**2
    load = np.linalg.eigh(cov)[1][:, ::-1][:, :k].T
    return load * np.sign(load[np.arange(len(load)), np.abs(load).argmax(1)])[:, None]


def project(vectors: DataFrame, vector: str, loadings: np.ndarray, prefix: str = "pc") -> DataFrame:
    """Adds the scores on ``loadings``, inside the row."""
    score = lambda w: sum((F.col(vector)[c].cast("double") * float(v) for c, v in enumerate(w)), F.lit(0.0))
    return vectors.withColumns({f"{prefix}{i}": score(w) for i, w in enumerate(loadings)})
