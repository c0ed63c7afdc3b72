"""Hidden Markov states and tails of streams of the grid."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.tails import gpd_fit, gpd_sf
from lagweave.operators import spans
from lagweave.sources.shared import dropped, written


def per_stream(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str, work: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """``work`` on each stream in order of b; it returns columns of the same length."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b").reset_index(drop=True)
        return pd.DataFrame({**{k: frame[k] for k in keys}, "b": frame["b"], **work(frame)})

    return rows.select(*keys, "b", *columns).groupBy(*keys).applyInPandas(run, f"{schema}, b int, {out}")


def own_rows(spread: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str, work: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """``work`` on each span of ``spans.haloed`` rows, halo included; the span's own rows are returned."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.select(*keys).schema)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b").reset_index(drop=True)
        return pd.DataFrame({**{k: frame[k] for k in keys}, "b": frame["b"], **work(frame)})[frame["_own"]]

    return spread.select(*keys, "b", "_span", "_own", *columns).groupBy(*keys, "_span").applyInPandas(run, f"{schema}, b int, {out}")


def _normal(x: np.ndarray, m: float, s: float) -> np.ndarray:
    return -0.5 * ((x - m) / s) ** 2 - np.log(s)


def hmm(x: np.ndarray, null_mean: float, null_sd: float, rate: float, episode_s: float = 7.5, rounds: int = 20) -> np.ndarray:
    """Posterior of the upper of two states. The lower mean is fixed; the upper stays a deviation above it."""
    x = np.nan_to_num(x)
    s0 = max(null_sd, 1e-8)
    upper = x[x > np.quantile(x, 0.75)] if len(x) else x
    m1 = max(float(upper.mean()) if len(upper) else null_mean, null_mean + s0)
    s1 = s0
    leave = float(np.clip(1 / (episode_s * rate), 1e-6, 0.3))
    a = np.array([[1 - 0.01 * leave, 0.01 * leave], [leave, 1 - leave]])
    start, last = np.array([0.95, 0.05]), -np.inf
    post = np.zeros((len(x), 2))
    for _ in range(rounds):
        e = np.stack([_normal(x, null_mean, s0), _normal(x, m1, s1)], 1)
        shift = e.max(1, keepdims=True)
        like = np.exp(e - shift)
        f, b, scale = np.zeros_like(like), np.ones_like(like), np.zeros(len(x))
        for t in range(len(x)):
            f[t] = like[t] * (start if t == 0 else f[t - 1] @ a)
            scale[t] = f[t].sum()
            f[t] /= scale[t]
        for t in range(len(x) - 2, -1, -1):
            b[t] = a @ (like[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        post = f * b
        post /= post.sum(1, keepdims=True)
        total = float((np.log(scale) + shift[:, 0]).sum())
        if abs(total - last) < 1e-6 * max(1.0, abs(total)):
            break
        last = total
        pair = f[:-1, :, None] * a[None] * (like[1:] * b[1:])[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        turn = pair.sum(0)
        up = np.clip(turn[0, 1] / max(turn[0].sum(), 1e-12), 1e-6, 0.3)
        down = np.clip(turn[1, 0] / max(turn[1].sum(), 1e-12), 1e-6, 0.3)
        a = np.array([[1 - up, up], [down, 1 - down]])
        w0, w1 = post.sum(0)
        s0 = max(float(np.sqrt((post[:, 0] * (x - null_mean) ** 2).sum() / max(w0, 1e-9))), 1e-8)
        m1 = float((post[:, 1] * x).sum() / max(w1, 1e-9))
        if m1 <= null_mean + s0:
            m1 = (null_mean + s0) + 0.01 * abs(null_mean + s0)
        s1 = max(float(np.sqrt((post[:, 1] * (x - m1) ** 2).sum() / max(w1, 1e-9))), 1e-8)
    return post[:, 1]


def hmm_posterior(rows: DataFrame, keys: Sequence[str], value: str, rate: float, chunk: int = 4096, episode_s: float = 7.5, rounds: int = 20) -> DataFrame:
    """(keys, b, posterior) of ``hmm``; fewer than 20 values or no spread give 0.

    Streams of up to ``chunk`` rows are one group each. Longer ones are worked in chunks: each gives the
    product of its 2 x 2 transfer matrices, one pass over the chunks of a stream carries the state to
    the borders both ways, and chunks are finished apart; sums of a round give the next parameters.
    """
    length = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    short = rows.join(length.where(F.col("_rows") <= chunk).select(*keys), list(keys), "left_semi")
    long = rows.join(length.where(F.col("_rows") > chunk).select(*keys), list(keys), "left_semi")

    def work(frame: pd.DataFrame) -> dict:
        x = frame[value].to_numpy(float)
        ok = np.isfinite(x).sum() >= 20 and np.nanstd(x) > 1e-12
        low = np.nan_to_num(x)[np.nan_to_num(x) <= np.nanmedian(x)] if ok else x
        return {"posterior": hmm(x, float(low.mean()), float(low.std()), rate, episode_s, rounds) if ok else np.zeros(len(x))}

    out = per_stream(short, keys, [value], "posterior double", work)
    return out.union(_long_hmm(long, keys, value, rate, chunk, episode_s, rounds)) if length.where(F.col("_rows") > chunk).limit(1).count() else out


def _long_hmm(rows: DataFrame, keys: Sequence[str], value: str, rate: float, chunk: int, episode_s: float, rounds: int) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    given = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double"))
    cut = written(rows.select(*keys, "b", given.alias("_raw"), F.coalesce(given, F.lit(0.0)).alias("_x"), F.floor(F.col("b") / chunk).alias("_chunk")))
    marks = cut.groupBy(*keys).agg(F.percentile("_raw", F.lit(0.5)).alias("_mid"), F.percentile("_x", F.lit(0.75)).alias("_high"), ((F.count("_raw") >= 20) & (F.stddev_pop("_raw") > 1e-12)).alias("ok"), F.min("_chunk").alias("_first"))
    lower, upper = F.when(F.col("_x") <= F.col("_mid"), F.col("_x")), F.when(F.col("_x") > F.col("_high"), F.col("_x"))
    leave = float(np.clip(1 / (episode_s * rate), 1e-6, 0.3))
    start = cut.join(marks, list(keys)).groupBy(*keys, "ok", "_first").agg(F.avg(lower).alias("m0"), F.greatest(F.coalesce(F.stddev_pop(lower), F.lit(0.0)), F.lit(1e-8)).alias("s0"), F.avg(upper).alias("m1"))
    m1 = F.greatest(F.coalesce("m1", "m0"), F.col("m0") + F.col("s0"))
    params = written(start.select(*keys, "ok", "_first", "m0", "s0", m1.alias("m1"), F.col("s0").alias("s1"), F.lit(0.01 * leave).alias("up"), F.lit(leave).alias("down"), F.lit(float("-inf")).alias("last"), F.lit(False).alias("done")))
    names = ["m0", "s0", "m1", "s1", "up", "down", "_first"]

    def steps(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """(values, transition, likelihoods over the larger, their logarithms, whether the stream starts here)."""
        m0, s0, m1, s1, up, down, first = (float(frame[c].iloc[0]) for c in names)
        x = frame["_x"].to_numpy(float)
        e = np.stack([_normal(x, m0, s0), _normal(x, m1, s1)], 1)
        shift = e.max(1)
        return x, np.array([[1 - up, up], [down, 1 - down]]), np.exp(e - shift[:, None]), shift, int(frame["_chunk"].iloc[0]) == int(first)

    def transfer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        _, a, like, shift, begins = steps(frame)
        m, scale = np.eye(2), float(shift.sum())
        for t in range(len(like)):
            m = (m if begins and t == 0 else m @ a) * like[t]
            size = m.sum()
            m, scale = m / size, scale + float(np.log(size))
        return pd.DataFrame({**{k: frame[k].iloc[:1].to_numpy() for k in keys}, "_chunk": frame["_chunk"].iloc[:1].to_numpy(), "m": [m.ravel()], "scale": [scale]})

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_chunk")
        every = [np.asarray(m).reshape(2, 2) for m in frame["m"]]
        v, into, total = np.array([0.95, 0.05]), [], float(frame["scale"].sum())
        for m in every:
            into.append(v)
            v = v @ m
            total += float(np.log(v.sum()))
            v = v / v.sum()
        w, out = np.ones(2), []
        for m in reversed(every):
            out.append(w)
            w = m @ w
            w = w / w.sum()
        return pd.DataFrame({**{k: frame[k].to_numpy() for k in keys}, "_chunk": frame["_chunk"].to_numpy(), "into": into, "out": out[::-1], "total": total})

    def passes(frame: pd.DataFrame, border: pd.DataFrame) -> tuple:
        x, a, like, _, begins = steps(frame)
        v, w = (np.asarray(border[c].iloc[0], float) for c in ("into", "out"))
        f, back = np.empty_like(like), np.empty_like(like)
        for t in range(len(like)):
            now = like[t] * (v if begins and t == 0 else v @ a)
            f[t] = v = now / now.sum()
        for t in range(len(like) - 1, -1, -1):
            back[t] = w
            w = a @ (like[t] * w)
            w = w / w.sum()
        post = f * back
        return x, a, like, begins, f, back, post / post.sum(1, keepdims=True), np.asarray(border["into"].iloc[0], float)

    def sums(frame: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        x, a, like, begins, f, back, post, into = passes(frame, border)
        before = np.concatenate([into[None], f[:-1]])[int(begins) :]
        pair = before[:, :, None] * a[None] * (like * back)[int(begins) :, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        turn, m0 = pair.sum(0), float(frame["m0"].iloc[0])
        got = [turn[0, 0], turn[0, 1], turn[1, 0], turn[1, 1], post[:, 0].sum(), (post[:, 0] * (x - m0) ** 2).sum(), post[:, 1].sum(), (post[:, 1] * x).sum(), (post[:, 1] * x * x).sum()]
        return pd.DataFrame({**{k: frame[k].iloc[:1].to_numpy() for k in keys}, **{c: [v] for c, v in zip(counted, got)}, "total": [float(border["total"].iloc[0])]})

    def finish(frame: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("b")
        return pd.DataFrame({**{k: frame[k].to_numpy() for k in keys}, "b": frame["b"].to_numpy(), "posterior": passes(frame, border)[6][:, 1]})

    counted = ["t00", "t01", "t10", "t11", "w0", "d0", "w1", "x1", "q1"]

    def borders(params: DataFrame) -> tuple[DataFrame, DataFrame]:
        live = cut.drop("_raw").join(params.where("ok").select(*keys, *names), list(keys))
        found = live.groupBy(*keys, "_chunk").applyInPandas(transfer, f"{kinds}, _chunk long, m array<double>, scale double")
        return live, found.groupBy(*keys).applyInPandas(carry, f"{kinds}, _chunk long, into array<double>, out array<double>, total double")  # a row a chunk

    for _ in range(rounds - 1):
        live, edge = borders(params.where("not done"))
        got = live.groupBy(*keys, "_chunk").cogroup(edge.groupBy(*keys, "_chunk")).applyInPandas(sums, f"{kinds}, " + ", ".join(f"{c} double" for c in counted) + ", total double")
        got = got.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counted], F.max("total").alias("total"))
        both = params.join(got, list(keys), "left")
        clipped = lambda part, whole: F.least(F.greatest(part / F.greatest(whole, F.lit(1e-12)), F.lit(1e-6)), F.lit(0.3))
        s0 = F.greatest(F.sqrt(F.col("d0") / F.greatest("w0", F.lit(1e-9))), F.lit(1e-8))
        mean = F.col("x1") / F.greatest("w1", F.lit(1e-9))
        m1 = F.when(mean <= F.col("m0") + s0, F.col("m0") + s0 + 0.01 * F.abs(F.col("m0") + s0)).otherwise(mean)
        s1 = F.greatest(F.sqrt(F.greatest(F.col("q1") - 2 * m1 * F.col("x1") + m1 * m1 * F.col("w1"), F.lit(0.0)) / F.greatest("w1", F.lit(1e-9))), F.lit(1e-8))
        stays = F.col("done") | F.col("total").isNull() | (F.abs(F.col("total") - F.col("last")) < 1e-6 * F.greatest(F.abs("total"), F.lit(1.0)))
        new = {"s0": s0, "m1": m1, "s1": s1, "up": clipped(F.col("t01"), F.col("t00") + F.col("t01")), "down": clipped(F.col("t10"), F.col("t10") + F.col("t11")), "last": F.col("total")}
        after = written(both.select(*keys, "ok", "_first", "m0", *[F.when(stays, F.col(c)).otherwise(v).alias(c) for c, v in new.items()], stays.alias("done")))
        dropped(params)
        params = after
        if not params.where("not done").limit(1).count():
            break
    live, edge = borders(params)
    known = live.groupBy(*keys, "_chunk").cogroup(edge.groupBy(*keys, "_chunk")).applyInPandas(finish, f"{kinds}, b int, posterior double")
    flat = cut.join(params.where("not ok").select(*keys), list(keys), "left_semi").select(*keys, "b", F.lit(0.0).alias("posterior"))
    return known.union(flat)


def gpd_pvalues(rows: DataFrame, keys: Sequence[str], real: str, nulls: str, half: int = 50, quantile: float = 0.9) -> DataFrame:
    """(keys, b, p): each value against the null draws (an array column) of the rows around it.

    Up to the ``quantile`` by rank, beyond by a generalised Pareto tail; at least 1 / (10 draws). Fewer
    than 20 pooled draws, a negative or missing value give 1.
    """

    def work(frame: pd.DataFrame) -> dict:
        x, draws = frame[real].to_numpy(float), np.stack(frame[nulls].to_numpy())
        h = half
        p = np.ones(len(x))
        for t, v in enumerate(x):
            pool = draws[max(0, t - h) : t + h + 1].ravel()
            pool = pool[np.isfinite(pool)]
            if len(pool) < 20 or not v >= 0:
                continue
            cut = np.quantile(pool, quantile)
            tail = gpd_fit(pool[pool > cut] - cut) if v > cut else None
            p[t] = (pool >= v).mean() if tail is None else (1 - quantile) * gpd_sf(np.array([v - cut]), *tail)[0]
            p[t] = max(p[t], 1 / (10 * draws.shape[1]))
        return {"p": p}

    spread = spans.haloed(rows.select(*keys, "b", real, nulls), half, half, 1024)
    return own_rows(spread, keys, [real, nulls], "p double", work)
