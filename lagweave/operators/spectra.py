"""Fourier transforms of whole long streams: two grouped passes with a shuffle between, and what stands on them.

An index of M = M1 * M2 places is a table of M1 rows and M2 columns. The first pass transforms columns, each
value is turned by its place, and after the transposing shuffle the second one transforms rows; a task holds a few
columns or rows. Any length goes through a power of two by Bluestein's chirp. Streams of up to ``WHOLE`` rows
are one group with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators.chunks import kinds
from lagweave.operators.episodes import clean
from lagweave.operators.regression import moments, square
from lagweave.operators.surrogates import empirical_p
from lagweave.sources.shared import dropped, written

#: Rows up to which a stream is one group, and values that a task of the passes holds about.
WHOLE, HELD = 1 << 16, 1 << 18


def _halves(m: int) -> tuple[int, int]:
    bits = m.bit_length() - 1
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def power_fft(values: DataFrame, keys: Sequence[str], inverse: bool = False) -> DataFrame:
    """(keys, m, j, re, im) transformed: ``m``, a power of two, is the length of each key's stream; absent j are 0.

    Not scaled by the length, whichever way.
    """
    kind, sign = kinds(values, keys), 1.0 if inverse else -1.0
    schema = f"{kind}, m long, j long, re double, im double"

    def group(frame: pd.DataFrame) -> tuple[dict, int, int, int]:
        m = int(frame["m"].iloc[0])
        return ({k: frame[k].iloc[0] for k in keys}, m, *_halves(m))

    def table(at: np.ndarray, along: np.ndarray, z: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        which, row = np.unique(at, return_inverse=True)
        t = np.zeros((len(which), n), complex)
        t[row, along] = z
        t = np.fft.fft(t, axis=1) if not inverse else np.fft.ifft(t, axis=1) * n
        return which, t

    def columns(frame: pd.DataFrame) -> pd.DataFrame:
        own, m, m1, m2 = group(frame)
        j = frame["j"].to_numpy()
        which, t = table(j % m2, j // m2, frame["re"].to_numpy() + 1j * frame["im"].to_numpy(), m1)
        k1 = np.arange(m1)
        t = t * np.exp(sign * 2j * np.pi * ((which[:, None] * k1[None]) % m) / m)
        return pd.DataFrame({**own, "m": m, "j": (k1[None] * m2 + which[:, None]).ravel(), "re": t.real.ravel(), "im": t.imag.ravel()})

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        own, m, m1, m2 = group(frame)
        j = frame["j"].to_numpy()
        which, t = table(j // m2, j % m2, frame["re"].to_numpy() + 1j * frame["im"].to_numpy(), m2)
        return pd.DataFrame({**own, "m": m, "j": (which[:, None] + m1 * np.arange(m2)[None]).ravel(), "re": t.real.ravel(), "im": t.imag.ravel()})

    low = F.lit(1).cast("long")
    half = F.floor(F.log2(F.col("m").cast("double")) / 2 + 1e-9).cast("int")
    m1, m2 = F.pow(F.lit(2.0), half).cast("long"), (F.col("m") / F.pow(F.lit(2.0), half)).cast("long")
    at = values.select(*keys, "m", "j", "re", "im")
    first = at.withColumn("_g", F.floor((F.col("j") % m2) / F.greatest(F.floor(F.lit(HELD) / m1), low))).groupBy(*keys, "_g").applyInPandas(columns, schema)
    return first.withColumn("_g", F.floor(F.floor(F.col("j") / m2) / F.greatest(F.floor(F.lit(HELD) / m2), low))).groupBy(*keys, "_g").applyInPandas(rows, schema)


def _size(n: str):  # noqa: ANN202
    """The power of two that holds a linear convolution of n values."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(2 * F.col(n) - 1, F.lit(2)).cast("double")))).cast("long")


def dft(values: DataFrame, keys: Sequence[str], inverse: bool = False) -> DataFrame:
    """(keys, n, j, re, im) transformed, for any length ``n`` of a key's stream; not scaled."""
    sign = 1.0 if inverse else -1.0
    turn = lambda j, n: F.lit(np.pi) * ((j * j) % (2 * n)).cast("double") / n
    cos, sin = F.cos(turn(F.col("j"), F.col("n"))), sign * F.sin(turn(F.col("j"), F.col("n")))
    a = values.select(*keys, "n", _size("n").alias("m"), "j", (F.col("re") * cos - F.col("im") * sin).alias("re"), (F.col("re") * sin + F.col("im") * cos).alias("im"))
    lengths = written(a.groupBy("n", "m").agg(F.lit(1).alias("one")).drop("one"))  # one chirp a length
    part = lengths.select("n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / WHOLE))).alias("part")).repartition("n", "part")
    chirp = part.select("n", "m", F.explode(F.sequence(F.col("part") * WHOLE, F.least(F.col("part") * WHOLE + WHOLE, F.col("n")) - 1)).alias("j"))
    both = chirp.withColumn("j", F.explode(F.when(F.col("j") == 0, F.array(F.col("j"))).otherwise(F.array(F.col("j"), F.col("m") - F.col("j")))))
    near = F.least(F.col("j"), F.col("m") - F.col("j"))
    b = both.select("n", "m", "j", F.cos(turn(near, F.col("n"))).alias("re"), (-sign * F.sin(turn(near, F.col("n")))).alias("im"))
    fa, fb = power_fft(a, [*keys, "n"]), power_fft(b, ["n"]).select("n", "j", F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = fa.join(fb, ["n", "j"]).select(*keys, "n", "m", "j", (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"))
    c = power_fft(product, [*keys, "n"], inverse=True).where("j < n")
    return c.select(*keys, "n", "j", ((F.col("re") * cos - F.col("im") * sin) / F.col("m")).alias("re"), ((F.col("re") * sin + F.col("im") * cos) / F.col("m")).alias("im"))


def phase(draw: int, f: int) -> float:
    """The phase of a frequency in a draw: an MD5 as a share of the circle."""
    return 2 * np.pi * int(hashlib.md5(f"{draw}:{f}".encode()).hexdigest()[:8], 16) / 2**32


def fourier_surrogates(rows: DataFrame, keys: Sequence[str], value: str, draws: int, whole: int = WHOLE) -> DataFrame:
    """(keys, k, b, surrogate): streams of the same spectrum with phases by hash; the mean and the Nyquist term stay.

    ``b`` counts from 0 without gaps, missing values are 0. Draws share their phases over streams.
    """
    kind = kinds(rows, keys)
    data = rows.select(*keys, F.col("b").cast("long").alias("j"), clean(value).alias("re"))
    ends = data.groupBy(*keys).agg((F.max("j") + 1).alias("n"))
    data = written(data.join(ends, list(keys)))

    def short(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        x = np.zeros(n)
        x[frame["j"].to_numpy()] = frame["re"].to_numpy()
        f = np.fft.rfft(x)
        turned = np.ones((draws, len(f)), complex)
        for k in range(draws):
            turned[k, 1 : (n + 1) // 2] = np.exp(1j * np.array([phase(k, i) for i in range(1, (n + 1) // 2)]))
        out = np.fft.irfft(f[None] * turned, n, 1) if n > 1 else np.repeat(x[None], draws, 0)
        own = {c: frame[c].iloc[0] for c in keys}
        return pd.DataFrame({**own, "k": np.repeat(np.arange(draws), n), "b": np.tile(np.arange(n), draws), "surrogate": out.ravel()})

    schema = f"{kind}, k int, b int, surrogate double"
    out = data.where(F.col("n") <= whole).groupBy(*keys).applyInPandas(short, schema)
    long = data.where(F.col("n") > whole)
    if not long.limit(1).count():
        return out
    spectrum = written(dft(long.withColumn("im", F.lit(0.0)), keys))
    half = F.least(F.col("j"), F.col("n") - F.col("j"))
    plain = (F.col("j") == 0) | (2 * F.col("j") == F.col("n"))
    angle = 2 * np.pi * F.conv(F.substring(F.md5(F.concat_ws(":", F.col("k").cast("string"), half.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    angle = F.when(plain, 0.0).when(2 * F.col("j") < F.col("n"), angle).otherwise(-angle)
    drawn = spectrum.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_a", angle)
    drawn = drawn.select(*keys, "k", "n", "j", (F.col("re") * F.cos("_a") - F.col("im") * F.sin("_a")).alias("re"), (F.col("re") * F.sin("_a") + F.col("im") * F.cos("_a")).alias("im"))
    back = dft(drawn, [*keys, "k"], inverse=True)
    return out.union(back.select(*keys, "k", F.col("j").cast("int").alias("b"), (F.col("re") / F.col("n")).alias("surrogate")))


def shifted_r2(rows: DataFrame, keys: Sequence[str], source: Sequence[str], own: Sequence[str], y: str, shifts: Sequence[int] | None = None, lam: float = 1e-3, whole: int = WHOLE) -> DataFrame:
    """(keys, s, r2_full, r2_restricted, dr2): ridge of ``y`` on its own columns and the source's, shifted by s round the end.

    Moments of all shifts come from ``cross_moments``; those of one side don't change. s = 0 is the real one;
    ``shifts`` names those to solve, None all.
    """
    every = [*own, y]
    cross = cross_moments(rows, keys, source, every, whole)
    cross = cross if shifts is None else cross.where(F.col("s").isin([0, *shifts]))
    lists = cross.groupBy(*keys, "s").agg(F.transform(F.sort_array(F.collect_list(F.struct("a", "c", "v"))), lambda x: x["v"]).alias("cross"))
    filled = rows.select(*keys, *[clean(c).alias(c) for c in (*source, *every)], F.lit(1.0).alias("_one"))
    left = moments(filled, keys, source).select(*keys, F.col("gram").alias("left"))
    right = moments(filled, keys, [*every, "_one"]).select(*keys, F.col("gram").alias("right"))
    ps, po = len(source), len(own)

    def solve(frames):
        for frame in frames:
            out = []
            for a, b, c in zip(frame["left"], frame["right"], frame["cross"]):
                a, b, c = square(a, ps), square(b, po + 2), np.asarray(c, float).reshape(ps, po + 1)
                g = np.block([[a, c[:, :po]], [c[:, :po].T, b[:po, :po]]])
                q, yy = np.concatenate([c[:, po], b[:po, po]]), b[po, po]
                total = yy - b[po, -1] ** 2 / b[-1, -1]

                def r2(at: slice) -> float:
                    m, v = g[at, at], q[at]
                    w = np.linalg.solve(m + lam * np.eye(len(v)), v) if len(v) else v
                    return float(np.clip(1 - (yy - 2 * w @ v + w @ m @ w) / total, -1, 1)) if total > 1e-10 else 0.0

                out.append((r2(slice(0, None)), r2(slice(ps, None))))
            full, part = np.array(out).reshape(-1, 2).T
            yield frame[[*keys, "s"]].assign(r2_full=full, r2_restricted=part, dr2=full - part)

    met = lists.join(left, list(keys)).join(right, list(keys))
    return met.mapInPandas(solve, f"{kinds(rows, keys)}, s int, r2_full double, r2_restricted double, dr2 double")


def shift_test(rows: DataFrame, keys: Sequence[str], source: Sequence[str], own: Sequence[str], y: str, shifts: Sequence[int], **options) -> DataFrame:
    """(keys, stat, n_null, p): what the source adds against what its ``shifts`` add."""
    fits = shifted_r2(rows, keys, source, own, y, shifts, **options).withColumn("stat", F.round("dr2", 9)).select(*keys, "s", "stat")
    return empirical_p(fits.where("s = 0").drop("s"), fits.where("s <> 0"), keys)


def cross_moments(rows: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str], whole: int = WHOLE) -> DataFrame:
    """(keys, s, a, c, v): of each shift s of the ``left`` columns round the end, the sum over b of left[a][b - s] * right[c][b].

    All shifts of a stream at once, as a circular correlation: transforms of either side once, products by
    frequency, one way back. ``b`` counts from 0 without gaps, missing values are 0; a and c are places in the lists.
    """
    kind = kinds(rows, keys)
    data = rows.select(*keys, F.col("b").cast("long").alias("j"), *[clean(c).alias(f"_l{i}") for i, c in enumerate(left)], *[clean(c).alias(f"_r{i}") for i, c in enumerate(right)])
    data = written(data.join(data.groupBy(*keys).agg((F.max("j") + 1).alias("n")), list(keys)))

    def short(frame: pd.DataFrame) -> pd.DataFrame:
        n, at = int(frame["n"].iloc[0]), frame["j"].to_numpy()
        out = []
        spectra = {}
        for name in [f"_l{i}" for i in range(len(left))] + [f"_r{i}" for i in range(len(right))]:
            x = np.zeros(n)
            x[at] = frame[name].to_numpy()
            spectra[name] = np.fft.rfft(x)
        own = {k: frame[k].iloc[0] for k in keys}
        for a in range(len(left)):
            for c in range(len(right)):
                v = np.fft.irfft(np.conj(spectra[f"_l{a}"]) * spectra[f"_r{c}"], n) if n > 1 else np.array([(spectra[f"_l{a}"] * spectra[f"_r{c}"])[0].real])
                out.append(pd.DataFrame({**own, "s": np.arange(n), "a": a, "c": c, "v": v}))
        return pd.concat(out)

    schema = f"{kind}, s int, a int, c int, v double"
    out = data.where(F.col("n") <= whole).groupBy(*keys).applyInPandas(short, schema)
    long = data.where(F.col("n") > whole)
    if not long.limit(1).count():
        return out
    sides = [F.struct(F.lit(side).alias("side"), F.lit(i).alias("col"), F.col(f"_{side}{i}").alias("re")) for side, cols in (("l", left), ("r", right)) for i in range(len(cols))]
    tall = long.select(*keys, "n", "j", F.explode(F.array(*sides)).alias("x")).select(*keys, "n", "j", "x.*", F.lit(0.0).alias("im"))
    spectrum = written(dft(tall, [*keys, "side", "col"]))
    one = spectrum.where("side = 'l'").select(*keys, "j", F.col("col").alias("a"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    two = spectrum.where("side = 'r'").select(*keys, "n", "j", F.col("col").alias("c"), "re", "im")
    product = two.join(one, [*keys, "j"]).select(*keys, "a", "c", "n", "j", (F.col("re") * F.col("_re") + F.col("im") * F.col("_im")).alias("re"), (F.col("im") * F.col("_re") - F.col("re") * F.col("_im")).alias("im"))
    back = written(dft(product, [*keys, "a", "c"], inverse=True).select(*keys, F.col("j").cast("int").alias("s"), "a", "c", (F.col("re") / F.col("n")).alias("v")))
    dropped(spectrum)
    return out.union(back)
