"""Recursions in chunks against plain versions in one pass."""

import numpy as np
import pytest

from lagweave.operators import episodes, switching


def kim(y, z, valid, order, rounds, stay=0.95, drift=1e-5):
    """One stream of channels, written out: y (channel, row), z (channel, row, basis)."""
    c, n, nb = z.shape
    z = z / np.maximum(np.sqrt((z**2).mean(1, keepdims=True)), 1e-8)
    res, own = np.zeros((c, n)), np.zeros(c)
    for i in range(c):
        past = np.stack([y[i, order - k - 1 : n - k - 1] for k in range(order)], 1)
        ok = np.array([valid[t - order : t + 1].all() for t in range(order, n)])
        a = np.linalg.solve(past[ok].T @ past[ok] + 1e-6 * np.eye(order), past[ok].T @ y[i, order:][ok])
        own[i] = max(np.var(y[i, order:][ok] - past[ok] @ a), 1e-8)
        res[i, order:] = y[i, order:] - past @ a
    trans, v = np.array([[stay, 1 - stay], [1 - stay, stay]]), np.stack([own, own])
    for _ in range(rounds):
        xi, mean, cov = np.zeros((n, 2)), np.zeros((2, c, nb)), np.stack([[np.eye(nb) * own[i] / nb for i in range(c)]] * 2)
        xi[0], err = 0.5, np.zeros((c, n))
        for t in range(1, n):
            if not valid[t]:
                xi[t] = xi[t - 1]
                continue
            log_f, cov = np.zeros(2), cov + drift * np.eye(nb)
            for i in range(c):
                for j in (0, 1):
                    d = np.diag(cov[j, i])
                    s = np.sqrt(np.minimum(10 * own[i] / nb / d, 1))
                    cov[j, i] = cov[j, i] * np.outer(s, s)
                log_f[0] += -0.5 * (np.log(2 * np.pi * v[0, i]) + res[i, t] ** 2 / v[0, i])
                f = z[i, t] @ cov[1, i] @ z[i, t] + v[1, i]
                e = res[i, t] - z[i, t] @ mean[1, i]
                log_f[1] += -0.5 * (np.log(2 * np.pi * f) + e * e / f)
                k = cov[1, i] @ z[i, t] / f
                mean[1, i], cov[1, i], err[i, t] = mean[1, i] + k * e, cov[1, i] - np.outer(k, k) * f, e * e
            joint = np.exp(log_f - log_f.max()) * np.maximum(trans.T @ xi[t - 1], 1e-10)
            xi[t] = joint / joint.sum()
            new_m, new_c = mean.copy(), cov.copy()
            for j in (0, 1):
                w = trans[:, j] * xi[t - 1]
                w = w / w.sum()
                for i in range(c):
                    new_m[j, i] = w @ mean[:, i]
                    new_c[j, i] = sum(w[g] * (cov[g, i] + np.outer(mean[g, i] - new_m[j, i], mean[g, i] - new_m[j, i])) for g in (0, 1))
            mean, cov = new_m, new_c
        post = xi.copy()
        for t in range(n - 2, -1, -1):
            post[t] = xi[t] * (trans @ (post[t + 1] / np.maximum(trans.T @ xi[t], 1e-10)))
            post[t] /= post[t].sum()
        w = post.sum(0)
        v = np.stack([np.maximum((post[:, 0] * res**2).sum(1) / max(w[0], 1), 1e-8), np.maximum((post[:, 1] * err).sum(1) / max(w[1], 1), 1e-8)])
        pair = post[:-1].T @ post[1:]
        for j in (0, 1):
            trans[j, j] = np.clip(pair[j, j] / pair[j].sum(), 0.5, 0.999)
            trans[j, 1 - j] = 1 - trans[j, j]
    return post[:, 1], v


@pytest.fixture(scope="module")
def coupled(spark):
    r = np.random.default_rng(11)
    n, c = 330, 3
    on = np.zeros(n)
    on[120:220] = 1
    x = r.normal(size=(c, n, 2))
    y = np.stack([np.convolve(r.normal(0, 0.7, n), [1, 0.5], "same") + on * (1.5 * x[i, :, 0] - x[i, :, 1]) for i in range(c)])
    valid = r.random(n) > 0.05
    valid[:5] = True
    rows = [("s", f"c{i}", t, float(y[i, t]), float(x[i, t, 0]), float(x[i, t, 1]), bool(valid[t])) for i in range(c) for t in range(n)]
    rows += [("short", "c0", t, float(y[0, t]), float(x[0, t, 0]), float(x[0, t, 1]), True) for t in range(9)]
    return spark.createDataFrame(rows, "s string, c string, b int, y double, x0 double, x1 double, ok boolean").repartition(3), y, x, valid, on


@pytest.mark.parametrize(("chunk", "run_in"), [(4096, 256), (100, 10)])
def test_switching_is_one_pass(coupled, chunk, run_in):
    rows, y, x, valid, on = coupled
    post, fits = switching.switching(rows, ["s"], "c", "y", ["x0", "x1"], order=2, rounds=2, valid="ok", chunk=chunk, run_in=run_in)
    got = post.where("s = 's'").toPandas().sort_values("b")["posterior"].to_numpy()
    plain, v = kim(y, x, valid, 2, 2)
    assert np.allclose(got, plain, atol=1e-6)
    f = fits.where("s = 's'").toPandas().sort_values("c")
    assert np.allclose(f["sigma2_0"], v[0], rtol=1e-5) and np.allclose(f["sigma2_1"], v[1], rtol=1e-5)
    assert got[on > 0].mean() > got[on == 0].mean() + 0.5
    assert post.where("s = 'short'").count() == 9


def normal(x, m, s):
    return -0.5 * ((x - m) / s) ** 2 - np.log(s)


def hsmm(x, m0, s0, rate, shortest=0.5, longest=30.0, mean_s=8.0, sd_s=5.0, rounds=10):
    """Posterior of the upper state, a matrix of (rows left) for each row, written out."""
    n = len(x)
    least = max(1, round(shortest * rate))
    most = max(least + 1, round(longest * rate))
    most = max(least + 1, n // 3) if n < 2 * most else most
    d = np.arange(1, most + 1)
    pmf = np.where(d >= least, np.exp(-0.5 * ((d - mean_s * rate) / (sd_s * rate)) ** 2), 0.0)
    pmf = pmf / pmf.sum()
    top = x[x > np.percentile(x, 75)]
    m1, s1, leave = max(top.mean(), m0 + 0.3 * s0), max(top.std(), 0.5 * s0), np.clip(1 / (10 * rate), 0.001, 0.3)
    for _ in range(rounds):
        like = np.exp(np.stack([normal(x, m0, s0), normal(x, m1, s1)], 1))
        f, b = np.zeros((n, most + 1)), np.ones((n, most + 1))
        f[0] = np.concatenate([[0.9 * like[0, 0]], 0.1 * pmf * like[0, 1]])
        for t in range(1, n):
            f[t, 0] = (f[t - 1, 0] * (1 - leave) + f[t - 1, 1]) * like[t, 0]
            f[t, 1:] = (np.append(f[t - 1, 2:], 0) + f[t - 1, 0] * leave * pmf) * like[t, 1]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t, 0] = (1 - leave) * like[t + 1, 0] * b[t + 1, 0] + leave * (pmf * like[t + 1, 1] * b[t + 1, 1:]).sum()
            b[t, 1] = like[t + 1, 0] * b[t + 1, 0]
            b[t, 2:] = like[t + 1, 1] * b[t + 1, 1:-1]
            b[t] /= b[t].max()
        g = f * b
        post = g[:, 1:].sum(1) / g.sum(1)
        m1 = max((post * x).sum() / post.sum(), m0 + 0.3 * s0)
        s1 = max(np.sqrt((post * (x - m1) ** 2).sum() / post.sum()), 0.3 * s0)
        up, stay = ((1 - post[:-1]) * post[1:]).sum(), ((1 - post[:-1]) * (1 - post[1:])).sum()
        leave = np.clip(up / (up + stay), 0.001, 0.3)
    return post


def stream(spark, seed=3, n=300):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, n)
    x[80:130] += 4
    x[200:212] += 3
    rows = [("k", t, float(v)) for t, v in enumerate(x)] + [("few", t, 1.0) for t in range(5)] + [("flat", t, 2.0) for t in range(40)]
    return spark.createDataFrame(rows, "k string, b int, x double").repartition(3), x


@pytest.mark.parametrize(("chunk", "run_in"), [(4096, 256), (90, 20)])
def test_hsmm_is_one_pass(spark, chunk, run_in):
    rows, x = stream(spark)
    got = episodes.hsmm_posterior(rows, ["k"], "x", 1.0, rounds=2, chunk=chunk, run_in=run_in).toPandas()
    low = x[x <= np.median(x)]
    plain = hsmm(x, float(low.mean()), float(low.std()), 1.0, rounds=2)
    p = got[got["k"] == "k"].sort_values("b")["posterior"].to_numpy()
    assert np.allclose(p, plain, atol=1e-6) and p[85:125].mean() > 0.8
    assert len(got) == len(x) + 45 and len(set(got["k"])) == 3 and set(got[got["k"] == "few"]["posterior"]) == {0.0}


def optimal(x):
    n = len(x)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    penalty = 2 * np.log(max(n, 2)) * max(float(x.var()), 1e-12)
    best, cut = np.full(n + 1, -penalty), np.zeros(n + 1, int)
    for t in range(1, n + 1):
        cost = [best[a] + (q[t] - q[a]) - (s[t] - s[a]) ** 2 / (t - a) for a in range(t)]
        cut[t] = int(np.argmin(cost))
        best[t] = cost[cut[t]] + penalty
    out, t = [], n
    while t > 0:
        t = cut[t]
        out.append(int(t))
    return out[::-1]


@pytest.mark.parametrize(("chunk", "run_in"), [(4096, 1024), (50, 10)])
def test_pelt_is_optimal_partitioning(spark, chunk, run_in):
    rows, x = stream(spark)
    got = episodes.pelt_segments(rows, ["k"], "x", chunk=chunk, run_in=run_in).toPandas()
    mine = got[got["k"] == "k"].sort_values("b")
    starts = mine.groupby("segment")["b"].min().tolist()
    assert starts == optimal(x)
    assert np.allclose(mine.groupby("segment")["mean"].first(), [x[a:b].mean() for a, b in zip(starts, [*starts[1:], len(x)])])
    assert got[got["k"] == "flat"]["segment"].nunique() == 1


def test_episodes_are_calibrated_on_draws(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2, 160))
    x[:, 60:100] += 2.5
    null = r.normal(size=(6, 2, 160))
    rows = spark.createDataFrame([("a", c, t, float(x[c, t])) for c in range(2) for t in range(160)], "s string, c int, b int, v double")
    draws = spark.createDataFrame([("a", c, k, t, float(null[k, c, t])) for k in range(6) for c in range(2) for t in range(160)], "s string, c int, k int, b int, v double")
    post, found = episodes.hsmm_localization(rows, draws, ["s"], "c", "v", 1.0, rounds=1)
    f = found.first()
    assert f["detected"] and f["fraction"] > f["threshold"] and abs(f["m0"]) < 0.3
    p = post.toPandas().sort_values("b")["posterior"].to_numpy()
    assert p[65:95].mean() > 0.8 and p[:50].mean() < 0.3
