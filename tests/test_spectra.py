"""Two-pass transforms against numpy, and what stands on them."""

import numpy as np
import pytest

from lagweave.operators import spectra


def tall(spark, streams):
    rows = [(s, len(x), j, float(v.real), float(v.imag)) for s, x in streams.items() for j, v in enumerate(np.asarray(x, complex))]
    return spark.createDataFrame(rows, "s string, n long, j long, re double, im double").repartition(3)


def back(df, name):
    f = df.where(f"s = '{name}'").toPandas().sort_values("j")
    return f["re"].to_numpy() + 1j * f["im"].to_numpy()


def test_transforms_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(spectra, "HELD", 16)
    r = np.random.default_rng(1)
    streams = {"a": r.normal(size=97) + 1j * r.normal(size=97), "b": r.normal(size=120), "c": r.normal(size=1), "d": r.normal(size=97)}
    for inverse in (False, True):
        got = spectra.dft(tall(spark, streams), ["s"], inverse).cache()
        for name, x in streams.items():
            assert np.allclose(back(got, name), np.fft.ifft(x) * len(x) if inverse else np.fft.fft(x), atol=1e-8)


def test_surrogates_and_correlations_are_the_same_either_way(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=75), r.normal(size=75)
    rows = spark.createDataFrame([("k", t, float(x[t]), float(y[t])) for t in range(75)], "s string, b int, x double, y double")
    one, two = (spectra.fourier_surrogates(rows, ["s"], "x", 2, whole=w).toPandas().sort_values(["k", "b"])["surrogate"].to_numpy() for w in (100, 10))
    assert np.allclose(one, two, atol=1e-9) and np.allclose(np.abs(np.fft.rfft(one[:75])), np.abs(np.fft.rfft(x)))
    plain = [sum(np.roll(x, s) * y) for s in range(75)]
    for w in (100, 10):
        got = spectra.cross_moments(rows.withColumnRenamed("s", "key"), ["key"], ["x"], ["y"], whole=w).toPandas().sort_values("s")
        assert np.allclose(got["v"], plain, atol=1e-8)


@pytest.mark.parametrize("whole", [1000, 10])
def test_shift_test_equals_regressions_of_shifted_rows(spark, whole):
    r = np.random.default_rng(3)
    n = 60
    x, z, o = r.normal(size=n), r.normal(size=n), r.normal(size=n)
    y = 0.8 * x + 0.5 * o + r.normal(size=n)
    rows = spark.createDataFrame([("p", t, *map(float, (x[t], z[t], o[t], y[t]))) for t in range(n)], "path string, b int, x double, z double, o double, y double")
    got = spectra.shifted_r2(rows, ["path"], ["x", "z"], ["o"], "y", [5, 17], whole=whole).toPandas().set_index("s")

    def r2(m):
        w = np.linalg.solve(m.T @ m + 1e-3 * np.eye(m.shape[1]), m.T @ y)
        return 1 - ((y - m @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    assert sorted(got.index) == [0, 5, 17]
    for s in (0, 5, 17):
        assert np.isclose(got.loc[s, "dr2"], r2(np.stack([np.roll(x, s), np.roll(z, s), o], 1)) - r2(o[:, None]), atol=1e-8)
    assert spectra.shift_test(rows, ["path"], ["x", "z"], ["o"], "y", range(6, 54, 2), whole=whole).first()["p"] < 0.1
