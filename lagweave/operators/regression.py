"""Distributed-lag regression: moments in Catalyst, small solves for each key in grouped Arrow tasks.

A group is one stream pair on a grid, of bounded length; nothing larger meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.tails import f_sf


def ridge_1d(rows: DataFrame, keys: Sequence[str], x: str, y: str, lam: float) -> DataFrame:
    """(keys, n, beta, r2): ridge without intercept on one predictor, all in one aggregate."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.var_pop(y).alias("v"))
    beta = F.col("xy") / (F.col("xx") + lam)
    sse = F.col("yy") - 2 * F.col("beta") * F.col("xy") + F.col("beta") * F.col("beta") * F.col("xx")
    r2 = F.when(F.col("v") * F.col("n") > 1e-10, F.least(F.greatest(1 - F.col("sse") / (F.col("v") * F.col("n")), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    return s.withColumn("beta", beta).withColumn("sse", sse).withColumn("r2", r2).select(*keys, "n", "beta", "r2")


def log_slope(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept, r2) of log(y) on log(x), over positive values."""
    lx, ly = F.log(x), F.log(y)
    return rows.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"))


def moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, gram): the upper triangle of X'X, row by row, in one map-side combined aggregate."""
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*pairs).alias("gram"))


def square(gram: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = gram
    return out + np.triu(out, 1).T


def nested_ridge(rows: DataFrame, keys: Sequence[str], source: Sequence[str], own: Sequence[str], y: str, lam: float = 1e-3) -> DataFrame:
    """(keys, n, r2_full, r2_restricted, dr2, f_stat, p): what ``source`` adds to ``own`` in predicting ``y``.

    Only the moments of a key leave the aggregate, so the solve is small whatever the number of rows.
    """
    cols = [*source, *own, y]
    p, ps = len(cols), len(source)
    summed = moments(rows, keys, cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summed.select(*keys).schema)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                g, n = square(r.gram, p), r.n
                yy = g[-1, -1]

                def sse(at: list[int], g=g, yy=yy) -> float:
                    if not at:
                        return yy
                    a, b = g[np.ix_(at, at)], g[at, -1]
                    w = np.linalg.solve(a + lam * np.eye(len(at)), b)
                    return yy - 2 * w @ b + w @ a @ w

                full, part = sse(list(range(p - 1))), sse(list(range(ps, p - 1)))
                r2 = [float(np.clip(1 - s / yy, -1, 1)) if yy > 1e-10 else 0.0 for s in (full, part)]
                dof = n - (p - 1)
                f = (part - full) / ps / (full / dof) if dof > 0 and full > 0 else 0.0
                out.append((*(getattr(r, k) for k in keys), n, *r2, r2[0] - r2[1], f, f_sf(f, ps, dof)))
            yield pd.DataFrame(out, columns=[*keys, "n", "r2_full", "r2_restricted", "dr2", "f_stat", "p"])

    return summed.mapInPandas(solve, f"{schema}, n long, r2_full double, r2_restricted double, dr2 double, f_stat double, p double")


def _decay(v: np.ndarray, gamma: float, carry: np.ndarray, back: bool) -> np.ndarray:
    """Decaying sums along the first axis: forward ones take the row itself, backward ones the rows after it."""
    out = np.empty_like(v)
    if back:
        for t in range(len(v) - 1, -1, -1):
            out[t] = carry
            carry = v[t] + gamma * carry
    else:
        for t in range(len(v)):
            carry = out[t] = v[t] + gamma * carry
    return out


def ewls(rows: DataFrame, keys: Sequence[str], source: Sequence[str], own: Sequence[str], y: str, gamma: float, lam: float = 1e-3, min_n: float = 20, chunk: int = 1024) -> DataFrame:
    """(keys, b, r2_full, r2_restricted, dr2): exponentially weighted least squares in both directions.

    Forward sums decay by ``gamma`` and take the row itself; backward ones hold the rows after it, the
    next with weight 1. Where the weights add up to less than ``min_n`` all is null. ``b`` has no gaps.

    A stream is worked in chunks. The decayed moments of each are summed in one aggregate, one pass
    over the chunks of a key carries them to the borders, and every chunk is finished on its own.
    """
    cols = [*source, *own]
    p = len(cols)
    parts = [F.lit(1.0), F.col(y), *(F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]), *(F.col(c) * F.col(y) for c in cols)]
    n_parts = len(parts)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    cut = rows.select(*keys, "b", F.col("valid").cast("double").alias("valid"), *cols, y).withColumn("_chunk", F.floor(F.col("b") / chunk))
    ahead, behind = F.pow(F.lit(gamma), (F.col("_chunk") + 1) * chunk - 1 - F.col("b")), F.pow(F.lit(gamma), F.col("b") - F.col("_chunk") * chunk)
    summed = cut.groupBy(*keys, "_chunk").agg(*[F.array(*[F.sum(w * F.col("valid") * m) for m in parts]).alias(name) for name, w in (("_ahead", ahead), ("_behind", behind))])

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_chunk")
        step = gamma**chunk
        into, out = [], []
        for column, sums, order in (("_ahead", into, 1), ("_behind", out, -1)):
            at, held, last = np.zeros(n_parts), [], None
            for c, v in zip(frame["_chunk"].to_numpy()[::order], frame[column].to_numpy()[::order]):
                at = at * step ** (abs(c - last) - 1) if last is not None else at
                held.append(at)
                at, last = np.asarray(v) + step * at, c
            sums.extend(held[::order])
        return pd.DataFrame({**{k: frame[k].to_numpy() for k in keys}, "_chunk": frame["_chunk"].to_numpy(), "_into": into, "_out": out})

    borders = summed.groupBy(*keys).applyInPandas(carry, f"{kinds}, _chunk long, _into array<double>, _out array<double>")

    def finish(frame: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        x, target, valid = frame[cols].to_numpy(float), frame[y].to_numpy(float), frame["valid"].to_numpy(float)
        up = np.triu_indices(p)
        v = np.concatenate([np.ones((len(x), 1)), target[:, None], x[:, up[0]] * x[:, up[1]], x * target[:, None]], 1) * valid[:, None]
        if len(frame) == 0:
            return pd.DataFrame({c: [] for c in (*keys, "b", "r2_full", "r2_restricted", "dr2")})
        s = _decay(v, gamma, np.asarray(border["_into"].iloc[0]), False) + _decay(v, gamma, np.asarray(border["_out"].iloc[0]), True)
        n, mean = s[:, 0], s[:, 1] / np.maximum(s[:, 0], 1e-12)
        a = np.zeros((len(x), p, p))
        a[:, up[0], up[1]] = s[:, 2 : 2 + len(up[0])]
        a = a + np.triu(a, 1).transpose(0, 2, 1)
        q, tot = s[:, 2 + len(up[0]) :], (target - mean) ** 2

        def fit(at: slice) -> np.ndarray:
            w = np.linalg.solve(a[:, at, at] + lam * np.eye(a[0, at, at].shape[0]), q[:, at, None])[..., 0]
            r2 = np.where(tot > 1e-10, 1 - (target - (w * x[:, at]).sum(1)) ** 2 / np.maximum(tot, 1e-10), 0.0)
            return np.where(n >= min_n, np.clip(r2, -1, 1), np.nan)

        full, part = fit(slice(0, p)), fit(slice(len(source), p))
        return pd.DataFrame({**{k: frame[k].to_numpy() for k in keys}, "b": frame["b"].to_numpy(), "r2_full": full, "r2_restricted": part, "dr2": full - part})

    return cut.groupBy(*keys, "_chunk").cogroup(borders.groupBy(*keys, "_chunk")).applyInPandas(finish, f"{kinds}, b int, r2_full double, r2_restricted double, dr2 double")


# group lasso on moments: scaled sums of products of all predictors and the target


def descend(gram: np.ndarray, q: np.ndarray, member: list[np.ndarray], alpha: float, w: np.ndarray | None = None, tol: float = 1e-9, sweeps: int = 2000) -> np.ndarray:
    """Least of 1/2 w'Gw - q'w + alpha * sum of group norms, by block coordinate descent.

    A block's best value solves its own condition: zero where its gradient is no longer than ``alpha``,
    else G_g w = r - alpha w / |w|, whose norm is the root of a rising function. It ends where the
    conditions of Karush, Kuhn and Tucker hold to ``tol``.
    """
    w = np.zeros(len(q)) if w is None else w.copy()
    blocks = [(m, *np.linalg.eigh(gram[np.ix_(m, m)])) for m in (np.flatnonzero(x) for x in member)]
    for _ in range(sweeps):
        worst = 0.0
        for m, values, vectors in blocks:
            r = q[m] - gram[m] @ w + gram[np.ix_(m, m)] @ w[m]
            size = float(np.linalg.norm(r))
            new = np.zeros(len(m))
            if size > alpha:
                turned = vectors.T @ r
                low, high = 0.0, size / max(float(values.min()), 1e-12)
                for _ in range(80):  # |w| = t where the norm of (G t + alpha)^-1 r is 1
                    t = (low + high) / 2
                    low, high = (t, high) if np.linalg.norm(turned / (values * t + alpha)) > 1 else (low, t)
                new = vectors @ (turned * high / (values * high + alpha)) if alpha > 0 else np.linalg.lstsq(gram[np.ix_(m, m)], r, rcond=None)[0]
            worst = max(worst, float(np.abs(new - w[m]).max(initial=0.0)))
            w[m] = new
        if worst <= tol:
            break
    return w


def lambda_max(q: np.ndarray, member: list[np.ndarray]) -> float:
    """The least penalty that leaves no group."""
    return max(float(np.linalg.norm(q[m])) for m in member)


def group_lasso(summed: DataFrame, keys: Sequence[str], groups: Sequence[str], alpha: float) -> DataFrame:
    """(keys, grp, norm, selected): group lasso on moments (keys, n, gram), whose last column is the target.

    ``groups`` names the group of each predictor.
    """
    names = list(dict.fromkeys(groups))
    member = [np.array([g == name for g in groups]) for name in names]
    p = len(groups) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summed.select(*keys).schema)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                s = square(r.gram, p) / max(r.n, 1)
                w = descend(s[:-1, :-1], s[:-1, -1], member, alpha)
                out += [(*(getattr(r, c) for c in keys), name, float(np.linalg.norm(w[m])), bool(np.linalg.norm(w[m]) > 1e-12)) for name, m in zip(names, member)]
            yield pd.DataFrame(out, columns=[*keys, "grp", "norm", "selected"])

    return summed.mapInPandas(solve, f"{schema}, grp string, norm double, selected boolean")


def lasso_path(summed: DataFrame, keys: Sequence[str], groups: Sequence[str], n_lambdas: int = 20, ratio: float = 0.01, gamma: float = 0.5) -> DataFrame:
    """(keys, step, lam, n_groups, rss, ebic, selected, best): the lasso along falling penalties, each from the last solution.

    Penalties fall evenly in the logarithm from the least that leaves no group. ``best`` marks the one of
    the least extended BIC: n log(rss / n) + k log n + 2 gamma log C(groups, k).
    """
    names = list(dict.fromkeys(groups))
    member = [np.array([g == name for g in groups]) for name in names]
    p = len(groups) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summed.select(*keys).schema)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                n = max(r.n, 1)
                s = square(r.gram, p) / n
                gram, q, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
                top, w, rows = lambda_max(q, member), np.zeros(p - 1), []
                for step, lam in enumerate(top * ratio ** (np.arange(n_lambdas) / max(1, n_lambdas - 1))):
                    w = descend(gram, q, member, float(lam), w)
                    chosen = [name for name, m in zip(names, member) if np.linalg.norm(w[m]) > 1e-12]
                    rss = max(n * float(yy - 2 * q @ w + w @ gram @ w), 1e-12)
                    k = len(chosen)
                    choose = lgamma(len(names) + 1) - lgamma(k + 1) - lgamma(len(names) - k + 1)
                    rows.append((step, float(lam), k, rss, n * np.log(rss / n) + k * np.log(n) + 2 * gamma * choose, chosen))
                best = min(rows, key=lambda x: (x[4], x[0]))[0]
                out += [(*(getattr(r, c) for c in keys), *row, row[0] == best) for row in rows]
            yield pd.DataFrame(out, columns=[*keys, "step", "lam", "n_groups", "rss", "ebic", "selected", "best"])

    return summed.mapInPandas(solve, f"{schema}, step int, lam double, n_groups int, rss double, ebic double, selected array<string>, best boolean")


def cross_validated(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], groups: Sequence[str], y: str, n_folds: int = 5, gap: int = 0, n_lambdas: int = 20, ratio: float = 0.001) -> DataFrame:
    """(keys, step, lam, r2, best): mean R2, clipped to 1, of time-blocked folds along a path of penalties.

    Rows are cut into ``n_folds`` spans of ``b``; a fold trains on rows over ``gap`` away from its span.
    Moments are summed once by key, fold and whether a row is inside or near each span, so a fold's
    training moments are a difference of sums.
    """
    names = list(dict.fromkeys(groups))
    member = [np.array([g == name for g in groups]) for name in names]
    p = len(groups) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    length = rows.groupBy(*keys).agg(((F.max("b") + 1) / n_folds).alias("_size"))
    cut = rows.join(F.broadcast(length), list(keys)).withColumn("fold", F.explode(F.expr(f"sequence(cast(greatest(0, floor((b - {gap}) / _size)) as int), cast(least({n_folds - 1}, floor((b + {gap}) / _size)) as int))")))
    cut = cut.withColumn("inside", F.floor(F.col("b") / F.col("_size")) == F.col("fold"))
    near = moments(cut, [*keys, "fold", "inside"], [*columns, y])
    whole = moments(rows, keys, [*columns, y]).select(*keys, F.lit(-1).alias("fold"), F.lit(False).alias("inside"), "n", "gram")
    every = near.select(*keys, "fold", "inside", "n", "gram").union(whole)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list] = {}
        for r in frame.itertuples(index=False):
            entry = held.setdefault(int(r.fold), [0.0, np.zeros((p, p)), 0.0, np.zeros((p, p))])
            g = square(r.gram, p)
            entry[0], entry[1] = entry[0] + r.n, entry[1] + g  # inside and near
            if r.inside:
                entry[2], entry[3] = entry[2] + r.n, entry[3] + g
        n, total, *_ = held.pop(-1)
        top = lambda_max(total[:-1, -1] / n, member)
        lams = top * ratio ** (np.arange(n_lambdas) / max(1, n_lambdas - 1))
        scores = np.full((len(held), n_lambdas), np.nan)
        for i, (m, out_, k, test) in enumerate(held[f] for f in sorted(held)):
            if n - m < 1 or k < 1 or test[-1, -1] <= 1e-10:
                continue
            s, w = (total - out_) / (n - m), np.zeros(p - 1)
            for j, lam in enumerate(lams):
                w = descend(s[:-1, :-1], s[:-1, -1], member, float(lam), w)
                scores[i, j] = np.clip(1 - (test[-1, -1] - 2 * test[:-1, -1] @ w + w @ test[:-1, :-1] @ w) / test[-1, -1], -1, 1)
        mean = np.array([np.nan if np.isnan(c).all() else np.nanmean(c) for c in scores.T])
        best = int(np.nanargmax(mean)) if np.isfinite(mean).any() else 0
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * n_lambdas for c in keys}, "step": range(n_lambdas), "lam": lams, "r2": mean, "best": [j == best for j in range(n_lambdas)]})

    return every.groupBy(*keys).applyInPandas(solve, f"{schema}, step int, lam double, r2 double, best boolean")  # at most two rows a fold
