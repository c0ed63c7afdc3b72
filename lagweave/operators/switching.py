"""Switching regressions: two regimes shared by many channels, filtered over long streams in chunks.

In regime 1 a channel's own source predicts what its past leaves; in regime 0 nothing does. The regime is one
for all channels: their log-likelihoods add up, so that noise in one channel moves little. The filter merges
regimes at each step and is no associative product, so long streams go by chunks whose borders agree in the end
(``chunks``). The smoother backwards is a product of 2 x 2 matrices, of which each chunk gives one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators import chunks, spans
from lagweave.operators.chunks import kinds
from lagweave.operators.regression import moments, square
from lagweave.sources.shared import dropped, written


@dataclass
class Regimes:
    """Stay and change probabilities, and each channel's noise in both regimes and variance of its own residual."""

    a: np.ndarray
    v0: np.ndarray
    v1: np.ndarray
    own: np.ndarray

    @classmethod
    def start(cls, own: np.ndarray, stay: float) -> Regimes:
        return cls(np.array([[stay, 1 - stay], [1 - stay, stay]]), own.copy(), own.copy(), own)

    @classmethod
    def row(cls, r) -> Regimes:  # noqa: ANN001
        return cls(np.asarray(r["a"], float).reshape(2, 2), *(np.asarray(r[c], float) for c in ("v0", "v1", "own")))


@dataclass
class State:
    """Regime probabilities, and of each channel and regime the mean and covariance of its coefficients."""

    xi: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def start(cls, own: np.ndarray, nb: int) -> State:
        c = len(own)
        return cls(np.array([0.5, 0.5]), np.zeros((c, 2, nb)), np.broadcast_to((own / nb)[:, None, None, None] * np.eye(nb), (c, 2, nb, nb)).copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.xi, self.mean.ravel(), self.cov.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, c: int, nb: int) -> State:
        flat = np.asarray(flat, float)
        return cls(flat[:2], flat[2 : 2 + 2 * c * nb].reshape(c, 2, nb), flat[2 + 2 * c * nb :].reshape(c, 2, nb, nb))


def filtered(y: np.ndarray, z: np.ndarray, valid: np.ndarray, p: Regimes, at: State, drift: float, penalty: float, first: bool) -> tuple[np.ndarray, np.ndarray, State]:
    """(regime probabilities by row, squared errors under regime 1 by channel and row, last state) from the state ``at``.

    ``y`` (channel, row), ``z`` (channel, row, basis). The ``first`` row of a stream is its start and not
    an observation; an invalid row keeps the state. Covariances are capped by scaling rows and columns alike.
    """
    c, n, nb = z.shape
    xi, mean, cov = at.xi, at.mean.copy(), at.cov.copy()
    out, errors = np.empty((n, 2)), np.zeros((c, n))
    cap, noise = (10 * p.own / nb)[:, None, None], drift * np.eye(nb)
    base = -0.5 * np.log(2 * np.pi * np.maximum(p.v0, 1e-20))
    for t in range(n):
        if first and t == 0 or not valid[t]:
            out[t] = xi
            continue
        ahead = np.maximum(p.a.T @ xi, 1e-10)
        cov += noise
        size = np.einsum("cjkk->cjk", cov)
        if (size > cap).any():
            s = np.sqrt(np.minimum(cap / np.maximum(size, 1e-10), 1.0))
            cov *= s[..., None] * s[..., None, :]
        yt, zt = y[:, t], z[:, t]
        e = yt - (zt * mean[:, 1]).sum(1)
        cz = np.einsum("cij,cj->ci", cov[:, 1], zt)
        f = (zt * cz).sum(1) + p.v1
        gain = cz / f[:, None]
        mean[:, 1] += gain * e[:, None]
        cov[:, 1] -= gain[:, :, None] * gain[:, None, :] * f[:, None, None]
        errors[:, t] = e * e
        safe = np.maximum(f, 1e-20)
        log_f = np.array([(base - 0.5 * yt * yt / np.maximum(p.v0, 1e-20)).sum(), (-0.5 * (np.log(2 * np.pi * safe) + e * e / safe)).sum() - penalty]) + np.log(ahead)
        joint = np.exp(log_f - log_f.max())
        w = p.a * xi[:, None]
        w = w / np.maximum(w.sum(0), 1e-300)
        xi = out[t] = joint / joint.sum()
        merged = np.einsum("ij,cik->cjk", w, mean)
        d = mean[:, :, None] - merged[:, None]  # channel, from, to, basis
        cov = np.einsum("ij,cikl->cjkl", w, cov) + np.einsum("ij,cijk,cijl->cjkl", w, d, d)
        mean = merged
    return out, errors, State(xi, mean, cov)


def backward(xi: np.ndarray, a: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of rows with filtered ``xi``; ``into`` is that of the row after them."""
    out, ahead = np.empty_like(xi), np.maximum(xi @ a, 1e-10)
    for t in range(len(xi) - 1, -1, -1):
        into = xi[t] * (a @ (into / ahead[t]))
        into = out[t] = into / max(into.sum(), 1e-300)
    return out


def transfer(xi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The 2 x 2 matrix by which ``backward`` takes the row after a chunk to its first row."""
    m, ahead = np.eye(2), np.maximum(xi @ a, 1e-10)
    for t in range(len(xi)):
        m = m @ (xi[t][:, None] * a / ahead[t])
    return m


def sums(post: np.ndarray, after: np.ndarray | None, y2: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """What a round needs of a chunk: pairs of regimes with the next row (that ``after`` the last), weights, squares by channel."""
    nxt = post[1:] if after is None else np.vstack([post[1:], after])
    pair = post[: len(nxt)].T @ nxt
    return np.concatenate([pair.ravel(), post.sum(0), y2 @ post[:, 0], errors @ post[:, 1]])


def refitted(p: Regimes, got: np.ndarray) -> Regimes:
    """Regimes from the added-up ``sums`` of a stream."""
    c = len(p.own)
    pair, w = got[:4].reshape(2, 2), got[4:6]
    a = p.a.copy()
    for j in (0, 1):
        if pair[j].sum() > 1:
            a[j, j] = np.clip(pair[j, j] / pair[j].sum(), 0.5, 0.999)
            a[j, 1 - j] = 1 - a[j, j]
    return Regimes(a, np.maximum(got[6 : 6 + c] / max(w[0], 1.0), 1e-8), np.maximum(got[6 + c :] / max(w[1], 1.0), 1e-8), p.own)


def prepared(rows: DataFrame, keys: Sequence[str], channel: str, target: str, basis: Sequence[str], order: int, valid: str | None) -> DataFrame:
    """(keys, channel, b, y, z, valid, own): what its own past leaves of the target, and the basis in units of its root mean square.

    ``own`` is the channel's variance of that. Rows with a missing value in their past don't fit; too few rows fit nothing.
    """
    by = [*keys, channel]
    ok = (F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)) & F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    some = rows.select(*by, "b", number(target).alias("y"), *[number(c).alias(f"_z{i}") for i, c in enumerate(basis)], ok.alias("valid"))
    w = Window.partitionBy(*by, "_span").orderBy("b")
    lagged = {f"_p{k}": F.coalesce(F.lag("y", k).over(w), F.lit(0.0)) for k in range(1, order + 1)}
    whole = (F.count("*").over(w.rowsBetween(-order, 0)) == order + 1) & F.min("valid").over(w.rowsBetween(-order, 0))
    some = spans.own(spans.haloed(some, order, 0).withColumns(lagged | {"_fit": whole}))
    past = list(lagged)
    scale = some.groupBy(*by).agg(F.min("b").alias("_first"), F.count("*").alias("_n"), F.var_pop("y").alias("_var"), F.array(*[F.greatest(F.sqrt(F.avg(F.col(f"_z{i}") * F.col(f"_z{i}"))), F.lit(1e-8)) for i in range(len(basis))]).alias("_rms"))
    fits = moments(some.where("_fit").withColumn("_one", F.lit(1.0)), by, [*past, "y", "_one"]).join(scale, by, "right")

    def solve(frames):
        for frame in frames:
            out, own = [], []
            for g, n, total, var in zip(frame["gram"], frame["n"], frame["_n"], frame["_var"]):
                coef, left = np.zeros(order), var
                if g is not None and n == n and n >= order + 5 and total >= 2 * order + 10:
                    m = square(g, order + 2)
                    coef = np.linalg.solve(m[:order, :order] + 1e-6 * np.eye(order), m[:order, order])
                    mean = (m[order, -1] - coef @ m[:order, -1]) / n
                    left = (m[order, order] - 2 * coef @ m[:order, order] + coef @ m[:order, :order] @ coef) / n - mean * mean
                out.append(coef)
                own.append(max(float(left), 1e-8))
            yield frame[by].assign(_coef=out, own=own, _first=frame["_first"], _rms=frame["_rms"])

    solved = fits.mapInPandas(solve, f"{kinds(rows, by)}, _coef array<double>, own double, _first int, _rms array<double>")
    left = F.col("y") - sum((F.col("_coef")[i] * F.col(c) for i, c in enumerate(past)), F.lit(0.0))
    met = some.join(solved, by)
    return met.select(*by, "b", F.when(F.col("b") - F.col("_first") >= order, left).otherwise(0.0).alias("y"), F.array(*[F.col(f"_z{i}") / F.col("_rms")[i] for i in range(len(basis))]).alias("z"), "valid", "own")


def tables(frame: pd.DataFrame, channel: str, names: Sequence[str], nb: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(b, y, z, valid) of a group as dense tables; a row that a channel lacks is invalid."""
    low, high = int(frame["b"].min()), int(frame["b"].max())
    n, place = high - low + 1, {str(c): i for i, c in enumerate(names)}
    c = frame[channel].astype(str).map(place).to_numpy()
    t = frame["b"].to_numpy() - low
    y, z, ok = np.zeros((len(names), n)), np.zeros((len(names), n, nb)), np.zeros((len(names), n), bool)
    y[c, t], z[c, t], ok[c, t] = frame["y"].to_numpy(), np.stack(frame["z"].to_numpy()), frame["valid"].to_numpy(bool)
    return np.arange(low, high + 1), y, z, ok.all(0)


def switching(rows: DataFrame, keys: Sequence[str], channel: str, target: str, basis: Sequence[str], order: int = 3, stay: float = 0.95, drift: float = 1e-5, rounds: int = 5, penalty: float = 0.0, valid: str | None = None, chunk: int = chunks.CHUNK, run_in: int = chunks.RUN_IN) -> tuple[DataFrame, DataFrame]:
    """((keys, b, posterior), (keys, channel, sigma2_0, sigma2_1, stay_0, stay_1)): the regime of a stream, shared by its channels.

    Streams of up to ``chunk`` rows are one group each; longer ones go by chunks of so many rows. ``b`` is
    whole numbers; a row that is missing or invalid in any channel keeps the state of the one before. With
    one channel a stream this is the filter of single channels.
    """
    nb = len(basis)
    data = written(prepared(rows, keys, channel, target, basis, order, valid))
    streams = written(data.groupBy(*keys, channel).agg(F.max("own").alias("own"), F.min("b").alias("low"), F.max("b").alias("high")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(channel).cast("string").alias("c"), "own"))).alias("cs"), F.min("low").alias("low"), F.max("high").alias("high")))  # channels of a stream
    streams = streams.select(*keys, F.transform("cs", lambda x: x["c"]).alias("names"), F.transform("cs", lambda x: x["own"]).alias("own"), "low", "high")
    out_kind = f"{kinds(rows, keys)}, low int, posterior array<double>, v0 array<double>, v1 array<double>, a array<double>"

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        names, own = list(frame["names"].iloc[0]), np.asarray(frame["_own"].iloc[0], float)
        b, y, z, ok = tables(frame, channel, names, nb)
        p, post = Regimes.start(own, stay), np.zeros((len(b), 2))
        for _ in range(rounds):
            xi, errors, _ = filtered(y, z, ok, p, State.start(own, nb), drift, penalty, True)
            post = backward(xi, p.a, np.maximum(xi[-1] @ p.a, 1e-10))
            p = refitted(p, sums(post, None, y * y, errors))
        return pd.DataFrame({**{k: frame[k].iloc[:1].to_numpy() for k in keys}, "low": b[:1], "posterior": [post[:, 1]], "v0": [p.v0], "v1": [p.v1], "a": [p.a.ravel()]})

    size = F.col("high") - F.col("low") + 1
    short = streams.where(size <= chunk)
    found = data.drop("own").join(short.select(*keys, "names", F.col("own").alias("_own")), list(keys)).groupBy(*keys).applyInPandas(whole, out_kind)
    parts, fits = found.select(*keys, "low", "posterior"), found.join(short.select(*keys, "names"), list(keys))
    if streams.where(size > chunk).limit(1).count():
        more, fit = _long(data, streams.where(size > chunk), keys, channel, nb, stay, drift, rounds, penalty, chunk, run_in)
        found = written(found.select(*keys, "low", "posterior", "v0", "v1", "a"))
        parts, fits = found.select(*keys, "low", "posterior").union(more), found.join(short.select(*keys, "names"), list(keys)).select(*keys, "names", "v0", "v1", "a").union(fit)
    at = parts.select(*keys, "low", F.posexplode("posterior").alias("_i", "posterior"))
    each = fits.select(*keys, F.explode(F.arrays_zip("names", "v0", "v1")).alias("x"), F.col("a")[0].alias("stay_0"), F.col("a")[3].alias("stay_1"))
    return at.select(*keys, (F.col("low") + F.col("_i")).cast("int").alias("b"), "posterior"), each.select(*keys, F.col("x.names").alias(channel), F.col("x.v0").alias("sigma2_0"), F.col("x.v1").alias("sigma2_1"), "stay_0", "stay_1")


def _long(data: DataFrame, streams: DataFrame, keys: Sequence[str], channel: str, nb: int, stay: float, drift: float, rounds: int, penalty: float, chunk: int, run_in: int) -> tuple[DataFrame, DataFrame]:
    by, kind, run_in = [*keys, "_span"], kinds(data, keys), min(run_in, chunk)
    cut = written(spans.haloed(data.drop("own").join(streams.select(*keys), list(keys), "left_semi"), run_in, 0, chunk))
    per = written(chunks.of(streams.select(*keys, "names", "low", "high"), keys, chunk))
    params = streams.select(*keys, F.lit([stay, 1 - stay, 1 - stay, stay]).cast("array<double>").alias("a"), F.col("own").alias("v0"), F.col("own").alias("v1"), "own")
    swept = f"{kind}, _span long, low int, start array<double>, end array<double>, xi array<double>, y2 array<double>, errors array<double>, m array<double>"

    def sweep(frame: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(at):
            return pd.DataFrame(columns=chunks.columns(swept))
        r = at.iloc[0]
        names, p, span = list(r["names"]), Regimes.row(r), int(r["_span"])
        low, high, own_low = int(r["low"]), min(int(r["high"]), span * chunk + chunk - 1), max(int(r["low"]), span * chunk)
        given = r["start"] is not None
        begin = own_low if given or own_low == low else max(low, own_low - run_in)
        frame = frame[frame["b"] >= begin]
        n = high - begin + 1
        y, z, ok = np.zeros((len(names), n)), np.zeros((len(names), n, nb)), np.zeros(n, bool)
        if len(frame):
            b, y1, z1, ok1 = tables(frame, channel, names, nb)
            at_ = slice(b[0] - begin, b[-1] - begin + 1)
            y[:, at_], z[:, at_], ok[at_] = y1, z1, ok1
        state = State.of(r["start"], len(names), nb) if given else State.start(p.own, nb)
        k = own_low - begin
        if k:
            _, _, state = filtered(y[:, :k], z[:, :k], ok[:k], p, state, drift, penalty, False)
        start = state.flat()
        xi, errors, end = filtered(y[:, k:], z[:, k:], ok[k:], p, state, drift, penalty, own_low == low)
        row = {**{c: [r[c]] for c in keys}, "_span": [span], "low": [own_low], "start": [start], "end": [end.flat()], "xi": [xi.ravel()], "y2": [(y[:, k:] ** 2).ravel()], "errors": [errors.ravel()], "m": [transfer(xi, p.a).ravel()]}
        return pd.DataFrame(row)

    def run(starts: DataFrame) -> DataFrame:
        live = per.join(params, list(keys)).join(starts, by)
        return cut.join(starts.select(*by), by, "left_semi").groupBy(*by).cogroup(live.groupBy(*by)).applyInPandas(sweep, swept)

    def carried(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_span")
        a = np.asarray(frame["a"].iloc[0], float).reshape(2, 2)
        into = np.maximum(np.asarray(frame["last"].iloc[-1], float) @ a, 1e-10)
        out = []
        for m in reversed(list(frame["m"])):
            out.append(into)
            into = np.asarray(m, float).reshape(2, 2) @ into
            into = into / max(into.sum(), 1e-300)
        return pd.DataFrame({**{k: frame[k].to_numpy() for k in keys}, "_span": frame["_span"].to_numpy(), "into": out[::-1]})

    def smoothed(frames):
        for frame in frames:
            post, got = [], []
            for xi, a, into, y2, errors, last in zip(frame["xi"], frame["a"], frame["into"], frame["y2"], frame["errors"], frame["is_last"]):
                xi = np.asarray(xi, float).reshape(-1, 2)
                p = backward(xi, np.asarray(a, float).reshape(2, 2), np.asarray(into, float))
                post.append(p[:, 1])
                got.append(sums(p, None if last else np.asarray(into, float), *(np.asarray(v, float).reshape(-1, len(xi)) for v in (y2, errors))))
            yield frame[[*keys, "_span", "low"]].assign(posterior=post, sums=got)

    def fitted(frames):
        for frame in frames:
            new = [refitted(Regimes.row(r), np.asarray(r["sums"], float)) for _, r in frame.iterrows()]
            yield frame[list(keys)].assign(a=[p.a.ravel() for p in new], v0=[p.v0 for p in new], v1=[p.v1 for p in new], own=frame["own"])

    parts = None
    for _ in range(rounds):
        done = chunks.agreed(per, keys, run)
        last = F.slice("xi", -2, 2)
        edges = done.select(*by, "m", last.alias("last")).join(params.select(*keys, "a"), list(keys)).groupBy(*keys).applyInPandas(carried, f"{kind}, _span long, into array<double>")  # a row a chunk
        ends = streams.select(*keys, F.floor(F.col("high") / chunk).alias("_last"))
        seen = done.join(edges, by).join(params.select(*keys, "a"), list(keys)).join(ends, list(keys)).withColumn("is_last", F.col("_span") == F.col("_last"))
        before, parts = parts, written(seen.select(*by, "low", "xi", "a", "into", "y2", "errors", "is_last").mapInPandas(smoothed, f"{kind}, _span long, low int, posterior array<double>, sums array<double>"))
        flat = parts.select(*keys, F.posexplode("sums").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        total = flat.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums"))  # 6 and two a channel
        dropped(done, *([before] if before is not None else []))
        params = written(params.join(total, list(keys)).mapInPandas(fitted, f"{kind}, a array<double>, v0 array<double>, v1 array<double>, own array<double>"))
    return parts.select(*keys, "low", "posterior"), params.join(streams.select(*keys, "names"), list(keys)).select(*keys, "names", "v0", "v1", "a")
