"""Kernels and operators against slow versions, planted truth and closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.functions.basis import raised_cosine
from lagweave.functions.tails import beta_inc, binom_sf, f_sf, gpd_fit, hypergeom_sf, norm_sf
from lagweave.operators import conditions, discovery, episodes, localize, metrics, regression, spectra, states, surrogates, temporal, wavelets
from lagweave.sources import streams


def test_tails():
    assert abs(norm_sf(1.959964) - 0.025) < 1e-6
    assert abs(f_sf(4.9646, 1, 10) - 0.05) < 1e-4
    assert abs(binom_sf(8, 10, 0.5) - 56 / 1024) < 1e-10
    assert abs(hypergeom_sf(2, 10, 4, 3) - (6 * 6 + 4) / 120) < 1e-10
    assert beta_inc(2, 3, 0) == 0 and beta_inc(2, 3, 1) == 1
    x = np.random.default_rng(0).exponential(2.0, 4000)
    shape, scale = gpd_fit(x)
    assert abs(shape) < 0.1 and abs(scale - 2) < 0.2 and gpd_fit(x[:5]) is None


def test_basis():
    b, lags = raised_cosine(4, 5.0)
    assert b.shape == (10, 4) and lags[0] == 0 and (b >= 0).all() and b.max() <= 1
    with pytest.raises(ValueError):
        raised_cosine(0, 5.0)


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"k": "s", "b": np.arange(n, dtype=np.int32), **columns}))


def test_ewls_equals_direct_weights(spark):
    r = np.random.default_rng(1)
    n, gamma, lam = 60, 0.9, 1e-3
    x, own, valid = r.normal(size=n), r.normal(size=n), r.random(n) > 0.1
    y = 0.8 * x + 0.3 * own + 0.1 * r.normal(size=n)
    got = regression.ewls(series(spark, valid=valid, x=x, own=own, y=y), ["k"], ["x"], ["own"], "y", gamma, lam, 5).toPandas().sort_values("b")
    t = 30
    d = np.arange(n) - t
    w = np.where(d <= 0, gamma ** (-d.clip(max=0)), gamma ** (d.clip(min=1) - 1)) * valid
    z = np.stack([x, own], 1)
    beta = np.linalg.solve((z * w[:, None]).T @ z + lam * np.eye(2), (z * w[:, None]).T @ y)
    mean = (w @ y) / w.sum()
    want = np.clip(1 - (y[t] - z[t] @ beta) ** 2 / (y[t] - mean) ** 2, -1, 1)
    assert abs(got["r2_full"].iloc[t] - want) < 1e-8


def test_nested_ridge_and_lasso_find_the_planted_source(spark):
    r = np.random.default_rng(2)
    n = 400
    a, b, own = r.normal(size=n), r.normal(size=n), r.normal(size=n)
    y = 0.7 * a + 0.2 * own + 0.5 * r.normal(size=n)
    rows = series(spark, a=a, b_=b, own=own, y=y)
    hit = regression.nested_ridge(rows, ["k"], ["a"], ["own"], "y").first()
    miss = regression.nested_ridge(rows, ["k"], ["b_"], ["own"], "y").first()
    assert hit["p"] < 1e-6 < miss["p"] and hit["dr2"] > 0.3 > miss["dr2"]
    chosen = regression.group_lasso(regression.moments(rows, ["k"], ["a", "b_", "own", "y"]), ["k"], ["a", "b", "own"], 0.15).toPandas().set_index("grp")["selected"]
    assert chosen["a"] and not chosen["b"]


def test_states_find_the_planted_episode(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, 200)
    x[80:130] += 4
    rows = series(spark, x=x)
    for posterior in (states.hmm_posterior(rows, ["k"], "x", 1.0), episodes.hsmm_posterior(rows, ["k"], "x", 1.0, rounds=3)):
        p = posterior.toPandas().sort_values("b")["posterior"].to_numpy()
        assert p[90:120].mean() > 0.8 and p[:60].mean() < 0.3
    seg = episodes.pelt_segments(rows, ["k"], "x").toPandas().sort_values("b")
    assert abs(int((seg["segment"] == 0).sum()) - 80) <= 3 and seg["segment"].nunique() == 3


def test_spectrum_and_power(spark):
    t = np.arange(256) / 32
    rows = series(spark, x=np.sin(2 * np.pi * 4 * t))
    got = spectra.fourier_surrogates(rows.withColumnRenamed("k", "stream"), ["stream"], "x", 2).where("k = 0").toPandas().sort_values("b")
    assert np.allclose(np.abs(np.fft.rfft(got["surrogate"].to_numpy())), np.abs(np.fft.rfft(np.sin(2 * np.pi * 4 * t))), atol=1e-8)
    power = np.stack(wavelets.morlet_power(rows, ["k"], "x", 32.0, (2.0, 4.0, 8.0)).toPandas().sort_values("b")["power"].to_numpy())
    assert power[128].argmax() == 1


def test_gpd_p_is_small_for_outliers(spark):
    r = np.random.default_rng(5)
    x = np.abs(r.normal(size=60))
    x[30] = 12.0
    rows = series(spark, x=x, nulls=[np.abs(r.normal(size=20)).tolist() for _ in range(60)])
    p = states.gpd_pvalues(rows, ["k"], "x", "nulls").toPandas().sort_values("b")["p"].to_numpy()
    assert p[30] == pytest.approx(1 / 200) and 0.2 < p.mean() < 0.8


def test_intervals_by_hand(spark):
    m = [(1, 5.0, "a_start"), (1, 7.0, "a_start"), (1, 9.0, "a_stop"), (1, 10.0, "a_stop"), (1, -2.0, "b_start"), (1, 99.0, "b_stop"), (1, 20.0, "c_start"), (2, 3.0, "a_stop")]
    got = conditions.condition_intervals(spark.createDataFrame(m, "session_id long, t double, label string"), spark.createDataFrame([(1, 50.0), (2, 9.0)], "session_id long, duration double"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 7.0, 9.0), (1, "b", 0.0, 50.0), (1, "c", 20.0, 50.0)]


def test_cusum_equals_recursion(spark):
    x = np.random.default_rng(6).normal(size=50)
    got = localize.cusum(series(spark, x=x, c=np.zeros(50)), ["k"], "x", "c", 0.1).toPandas().sort_values("b")
    c, want = 0.0, [0.0]
    for v in x[1:]:
        c = max(0.0, c + v - 0.1)
        want.append(c)
    assert np.allclose(got["forward"], want)


def test_empty_and_missing(spark):
    none = spark.createDataFrame([], "k string, t double, x double")
    assert temporal.grid(none, ["k"], 1.0).count() == 0
    flat = temporal.zscore_clip(series(spark, x=np.ones(5), valid=np.ones(5, bool)), ["k"])
    assert {r["z"] for r in flat.collect()} == {0.0}
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.roc_auc(one, "y", "s").first()["auc"] is None
    tests = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.04)], "n string, p double")
    got = {r["n"]: r["p_adjusted"] for r in surrogates.bh_fdr(tests, ["n"]).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 1.0})
    dims = spark.createDataFrame([("x",), ("y",)], "modality string")
    assert discovery.pathways(dims).count() == 4


def test_session_store(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "eeg", 0.0, 1.0), ("s1", "ecg", 0.0, 2.0), ("s2", "eeg", 0.0, 3.0)], "session_id string, modality string, t double, x double")
    streams.write_session_store(rows, str(tmp_path / "store"))
    back = streams.read_session_store(spark, str(tmp_path / "store"), ["s1"], ["eeg"])
    assert [r["x"] for r in back.select("x").collect()] == [1.0]
    assert "PartitionFilters" in back._jdf.queryExecution().toString()
    listing = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2)], "name string, path string, mtime long")
    assert streams.latest_versions(listing).first()["path"] == "p2"


def test_shifts_are_permutations(spark):
    got = surrogates.circular_shifts(series(spark, x=np.arange(20.0)).withColumnRenamed("k", "g"), ["g"], 20, 3)
    assert got.groupBy("k").agg(F.count_distinct("b").alias("n")).where("n <> 20").count() == 0
