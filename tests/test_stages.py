"""Long streams in spans, lasso paths, screens, decisions and the result store against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions.basis import multi_band, raised_cosine
from lagweave.operators import conditions, localize, pairs, regression, screening, spans, stage2, states, temporal, wavelets
from lagweave.sources import results


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((3, 90))
    rows = [(int(k), int(b), float(x[k, b]), bool(b % 11)) for k in range(3) for b in range(90)]
    return x, spark.createDataFrame(rows, "k long, b int, x double, valid boolean")


def by(df, *columns):
    out = df.orderBy("k", "b").toPandas()
    return [out[c].to_numpy().reshape(3, -1) for c in columns]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_spans_give_what_whole_streams_give(series, size):
    x, df = series
    up, later = by(spans.running(spans.running(df, ["k"], ["b"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, size), ["k"], ["b"], {"q": ("min", F.col("x"))}, size, inclusive=False, later=True), "s", "q")
    assert np.allclose(up, np.cumsum(x, 1)) and np.isnan(later[:, -1]).all() and np.allclose(later[:, 0], x[:, 1:].min(1))
    w = {-2: 0.5, 0: 1.0, 3: -2.0}
    (got,) = by(spans.lag_sums(df, ["k"], "x", {"y": w}, size), "y")
    want = np.zeros_like(x)
    for lag, v in w.items():
        for b in range(90):
            if 0 <= b - lag < 90:
                want[:, b] += v * x[:, b - lag]
    assert np.allclose(got, want)


def test_short_events_go(series, monkeypatch):
    x, df = series
    monkeypatch.setattr(spans, "SPAN", 5)
    (kept,) = by(temporal.min_event(df.withColumn("up", F.col("x") > -0.5), ["k"], "up", 4), "kept")
    want = np.zeros_like(x, bool)
    for k in range(3):
        for a in range(87):
            if (x[k, a : a + 4] > -0.5).all():
                want[k, a : a + 4] = True
    assert (kept == want).all()


def slow_ewls(x, y, v, gamma, lam, least):
    n = len(y)
    out = np.full(n, np.nan)
    for t in range(n):
        w = np.array([gamma ** (t - s) if s <= t else gamma ** (s - t - 1) for s in range(n)]) * v
        if w.sum() < least:
            continue
        beta = np.linalg.solve((x * w[:, None]).T @ x + lam * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        tot = (y[t] - (w * y).sum() / w.sum()) ** 2
        out[t] = np.clip(1 - (y[t] - x[t] @ beta) ** 2 / tot, -1, 1) if tot > 1e-10 else 0
    return out


@pytest.mark.parametrize("chunk", [1, 13, 500])
def test_chunked_ewls_equals_the_definition(spark, chunk):
    r = np.random.default_rng(3)
    x, y, v = r.standard_normal((70, 3)), r.standard_normal(70), (r.random(70) < 0.8).astype(float)
    v[:5] = v[40:50] = 0
    df = spark.createDataFrame([(1, b, *map(float, x[b]), float(y[b]), bool(v[b])) for b in range(70)], "k long, b int, a double, c double, d double, y double, valid boolean")
    out = regression.ewls(df, ["k"], ["a", "c"], ["d"], "y", 0.9, 1e-3, 4, chunk).orderBy("b").toPandas()
    assert np.allclose(out["r2_full"], slow_ewls(x, y, v, 0.9, 1e-3, 4), equal_nan=True) and np.allclose(out["r2_restricted"], slow_ewls(x[:, 2:], y, v, 0.9, 1e-3, 4), equal_nan=True)


def test_lasso_path_and_folds(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((160, 6))
    y = x[:, 0] - x[:, 1] + 0.3 * r.standard_normal(160)
    groups = ["a", "a", "b", "b", "c", "c"]
    member = [np.array([g == n for g in groups]) for n in "abc"]
    df = spark.createDataFrame([(7, b, *map(float, x[b]), float(y[b])) for b in range(160)], "k long, b int, x0 double, x1 double, x2 double, x3 double, x4 double, x5 double, y double")
    columns = [f"x{i}" for i in range(6)]
    path = regression.lasso_path(regression.moments(df, ["k"], [*columns, "y"]), ["k"], groups, 10).orderBy("step").collect()
    assert path[0]["n_groups"] == 0 and path[0]["lam"] == pytest.approx(max(np.linalg.norm(x[:, m].T @ y) / 160 for m in member))
    assert [p["selected"] for p in path if p["best"]] == [["a"]]
    for p in path:
        w = regression.descend(x.T @ x / 160, x.T @ y / 160, member, p["lam"])
        assert p["rss"] == pytest.approx(((y - x @ w) ** 2).sum(), rel=1e-5)
    folds = regression.cross_validated(df, ["k"], columns, groups, "y", 4, 5, 6, 0.01).orderBy("step").collect()
    top = path[0]["lam"]
    for j, f in enumerate(folds):
        lam, scores = top * 0.01 ** (j / 5), []
        for i in range(4):
            test = np.arange(160) // 40 == i
            train = np.array([not (40 * i - 5 <= b < 40 * i + 45) for b in range(160)])
            w = regression.descend(x[train].T @ x[train] / train.sum(), x[train].T @ y[train] / train.sum(), member, lam)
            scores.append(np.clip(1 - ((y[test] - x[test] @ w) ** 2).sum() / (y[test] ** 2).sum(), -1, 1))
        assert f["lam"] == pytest.approx(lam) and f["r2"] == pytest.approx(np.mean(scores), abs=1e-4)
    assert sum(f["best"] for f in folds) == 1


def test_screens(spark):
    r = np.random.default_rng(5)
    n, c, nb = 80, 6, 2
    x, e = r.standard_normal((n, c, nb)), r.standard_normal((n, c))
    e[:, 0] += 2 * x[:, 0, 0]
    rows = []
    for k in range(-1, 20):
        moved = np.roll(x, 5 + 3 * k, 0) if k >= 0 else x
        rows += [("p", k, i, *map(float, moved[t, i]), float(e[t, i])) for t in range(n) for i in range(c)]
    got = screening.matched_screen(spark.createDataFrame(rows, "path string, k int, channel int, x0 double, x1 double, r double"), ["path"], "channel", ["x0", "x1"], "r").first()
    mean = np.mean([x[:, i].T @ x[:, i] / n for i in range(c)], 0)
    stats = []
    for k in range(-1, 20):
        moved = np.roll(x, 5 + 3 * k, 0) if k >= 0 else x
        s = np.sort([(cc := moved[:, i].T @ e[:, i] / n) @ np.linalg.inv(mean) @ cc for i in range(c)])[::-1]
        stats.append([s.sum(), s[0], s[:2].sum()])
    stats = np.array(stats)
    z = (stats - stats[1:].mean(0)) / stats[1:].std(0)
    assert got["total"] == pytest.approx(stats[0, 0]) and got["upper"] == pytest.approx(stats[0, 2]) and got["max_z"] == pytest.approx(z[0].max())
    assert got["p"] == pytest.approx(((z[1:].max(1) >= z[0].max()).sum() + 1) / 21)
    cross = [(k, i, j, float(v)) for k in range(-1, 5) for i, row in enumerate(r.standard_normal((3, 4)) * (1 if k >= 0 else 4)) for j, v in enumerate(row)]
    table = {k: np.array([[v for kk, i, j, v in cross if kk == k and i == a] for a in range(3)]) for k in range(-1, 5)}
    one = screening.svd_screen(spark.createDataFrame([("p", *x) for x in cross], "path string, k int, i int, j int, v double"), ["path"], "i", "j", "v").first()
    sigma = {k: np.linalg.svd(m)[1][0] for k, m in table.items()}
    assert one["sigma"] == pytest.approx(sigma[-1]) and one["p"] == pytest.approx((sum(sigma[k] >= sigma[-1] for k in range(5)) + 1) / 6)


def test_own_past_of_three_rows(series):
    x, df = series
    past = temporal.ar_terms(df, ["k"], 3, "x")
    (got,) = by(screening.whitened(past, ["k"], "x", ["ar1", "ar2", "ar3"]), "residual")
    for k in range(3):
        a = np.stack([np.concatenate([np.zeros(i), x[k, :-i]]) for i in (1, 2, 3)], 1)
        assert np.allclose(got[k], x[k] - a @ np.linalg.solve(a.T @ a + 1e-3 * np.eye(3), a.T @ x[k]))


def test_canonical_coherence_in_spans(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = r.standard_normal((60, 4))
    x[:, 3] = x[:, 0]
    df = spark.createDataFrame([(1, b, *map(float, x[b])) for b in range(60)], "k long, b int, p double, q double, u double, v double")
    whole = wavelets.canonical_coherence(df, ["k"], ["p", "q"], ["u", "v"], 8.0, (1.0, 2.0)).orderBy("b").toPandas()["coherence"].to_numpy()
    monkeypatch.setattr(spans.haloed, "__defaults__", (16, "b"))
    cut = wavelets.canonical_coherence(df, ["k"], ["p", "q"], ["u", "v"], 8.0, (1.0, 2.0)).orderBy("b").toPandas()["coherence"].to_numpy()
    assert np.allclose(whole, cut) and (whole > 0.9).all() and (whole <= 1).all()


def test_f_test_tails_agree(spark):
    rows = spark.createDataFrame([(0.3, 0.1, 40), (0.9, 0.2, 12), (0.1, 0.2, 30), (0.5, 0.4, 3), (None, 0.1, 9)], "r2_full double, r2_restricted double, n int")
    closed = [r["p"] for r in stage2.f_test_timecourse(rows, 4, 2).collect()]
    scipy_free = [r["p"] for r in stage2.f_test_timecourse(rows, 5, 2).collect()]
    assert closed[2] == 1 and closed[3] == closed[4] == 1 and closed[1] < 0.01 and closed[0] == pytest.approx((1 + (0.2 / 0.7)) ** -18, rel=1e-9)
    assert scipy_free[2] == 1 and scipy_free[3] == 1 and 0 < scipy_free[0] < 1


def test_intervals_without_length_are_dropped(spark):
    marks = [("s", 5.0, "a_start"), ("s", 20.0, "a_start"), ("s", -3.0, "b_start"), ("s", -1.0, "b_stop"), ("s", 2.0, "c_start"), ("s", 2.0, "c_stop")]
    out = conditions.condition_intervals(spark.createDataFrame(marks, "session_id string, t double, label string"), spark.createDataFrame([("s", 10.0)], "session_id string, duration double"))
    assert out.collect() == []
    rows = spark.createDataFrame([("s", 1.0, 1), ("s", 1.0, 1), ("s", 4.0, 2)], "session_id string, t double, v int")
    two = spark.createDataFrame([("s", "a", 0.0, 2.0), ("s", "a", 1.0, 3.0), ("s", "a", 8.0, 9.0)], "session_id string, condition string, t_start double, t_stop double")
    assert conditions.with_conditions(rows, two, 1.5).count() == 2


def test_bases_of_bands():
    basis, lags, cuts = multi_band([(3, 0.0, 5.0), (2, 2.0, 12.0)], 2.0)
    phi, at = raised_cosine(2, 12.0, 2.0, 2.0)
    assert basis.shape == (24, 5) and cuts == [slice(0, 3), slice(3, 5)] and (basis[lags < 2.0][:, 3:] == 0).all() and (basis[lags > 5.0][:, :3] == 0).all()
    assert np.allclose(basis[:, 3], np.interp(lags, at, phi[:, 0], left=0, right=0)) and pairs.n_predictors(4, 3, 6, 3) == (33, 9)


def test_result_store(spark, tmp_path):
    path = str(tmp_path / "runs")
    found = spark.createDataFrame([("a", "b", True), ("b", "a", False)], "src string, tgt string, significant boolean")
    course = spark.createDataFrame([("a", "b", 0, 0.1), ("a", "b", 1, 0.3), ("b", "a", 0, 0.0)], "src string, tgt string, b int, dr2 double")
    for session in ("y_01", "y_02"):
        results.save_result({"pathways": found, "series": course}, path, session, "p1-p2")
    results.save_result({"pathways": found.where("significant")}, path, "y_02", "p1-p2")
    with pytest.raises(ValueError):
        results.save_result({"other": found}, path, "y_02", "p1-p2")
    assert results.load_result(spark, path, "pathways").count() == 3 and results.load_result(spark, path, "pathways", "y_01").count() == 2
    back = {(r["session_id"], r["src"]): r["mean_dr2"] for r in results.load_direction(spark, path, "p1-p2").collect()}
    assert back == {("y_01", "a"): pytest.approx(0.2), ("y_01", "b"): 0.0, ("y_02", "a"): pytest.approx(0.2)}
    made = []
    for _ in range(2):
        out = results.with_features(found, str(tmp_path / "features"), {"sig": lambda df: made.append(1) or df.where("significant")})
    assert len(made) == 1 and out["sig"].count() == 1
    names = spark.createDataFrame([("y_02", "x"), ("y_01", "x"), ("z", "x")], "name string, path string")
    assert results.find_sessions(names, "y_").first()["name"] == "y_01" and results.missing(names, names.where("name = 'z'"), ["name"]).count() == 2


def test_long_hidden_states_equal_one_pass(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(3):
        up = np.zeros(150) if k < 2 else None
        if up is not None:
            up[40:70] = up[100:125] = 2.5
            x = r.standard_normal(150) + up
        else:
            x = np.ones(150)
        rows += [(k, b, float(v)) for b, v in enumerate(x)]
        low = x[x <= np.median(x)]
        want[k] = states.hmm(x, float(low.mean()), float(low.std()), 1.0, rounds=5) if k < 2 else np.zeros(150)
    df = spark.createDataFrame(rows, "k int, b int, x double")
    for chunk in (1000, 32):
        out = states.hmm_posterior(df, ["k"], "x", 1.0, chunk, rounds=5).orderBy("k", "b").toPandas()
        for k, post in want.items():
            assert np.allclose(out["posterior"][out["k"] == k].to_numpy(), post, atol=1e-6)


def test_one_failure_keeps_no_other_session_back(spark, tmp_path):
    def broken():
        raise ValueError("no such recording")

    makers = {"a": lambda: spark.range(3), "b": broken, "c": lambda: spark.range(2).selectExpr("assert_true(id < 1)"), "d": lambda: spark.range(4)}
    done, failed = results.ensure_all(spark, str(tmp_path), makers)
    assert {n: df.count() for n, df in done.items()} == {"a": 3, "d": 4} and set(failed) == {"b", "c"} and "no such recording" in failed["b"]
    done, failed = results.ensure_all(spark, str(tmp_path), {**makers, "a": broken, "b": lambda: spark.range(1)})  # a is there
    assert set(done) == {"a", "b", "d"} and set(failed) == {"c"}


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_cusum_by_spans(spark, monkeypatch, size):
    monkeypatch.setattr(spans, "SPAN", size)
    x = np.random.default_rng(1).normal(size=60)
    ahead, back = np.zeros(60), np.zeros(60)
    for t in range(1, 60):
        ahead[t] = max(0, ahead[t - 1] + x[t] - 0.1)
    for t in range(58, -1, -1):
        back[t] = max(0, back[t + 1] + x[t] - 0.1)
    df = spark.createDataFrame([("k", t, float(v)) for t, v in enumerate(x)], "k string, b int, x double").withColumn("c", F.lit(0.1))
    out = localize.cusum(df, ["k"], "x", "c").toPandas().sort_values("b")
    assert np.allclose(out["forward"], ahead) and np.allclose(out["backward"], back)
