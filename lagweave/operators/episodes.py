"""Episodes of a set length (hidden semi-Markov) and change points (PELT) in long streams, by chunks.

Both carry more than a few numbers over a border: the one how long an episode still lasts, the other all
change points that may yet turn out best. ``chunks`` makes the borders agree, so results are those of one pass.
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
from lagweave.sources.shared import dropped, written


def clean(value: str):  # noqa: ANN201
    """A number; missing ones are 0."""
    return F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))


@dataclass
class Episodes:
    """Noise below and above, the chance to leave the lower state, and how long episodes last."""

    m0: float
    s0: float
    m1: float
    s1: float
    leave: float
    length: np.ndarray

    @classmethod
    def row(cls, r, rate: float, shortest: float, longest: float, mean_s: float, sd_s: float) -> Episodes:  # noqa: ANN001
        return cls(*(float(r[c]) for c in ("m0", "s0", "m1", "s1", "leave")), lengths(int(r["n"]), rate, shortest, longest, mean_s, sd_s))

    def likelihoods(self, x: np.ndarray) -> np.ndarray:
        """Of both states by row, over the larger."""
        e = np.stack([-0.5 * ((x - m) / s) ** 2 - np.log(s) for m, s in ((self.m0, self.s0), (self.m1, self.s1))], 1)
        return np.exp(e - e.max(1, keepdims=True))

    def start(self) -> np.ndarray:
        """Before the first row, as ``forward`` has it: a tenth begins inside an episode."""
        return np.concatenate([[0.9], 0.1 * self.length])

    def forward(self, like: np.ndarray, at: np.ndarray, first: bool) -> np.ndarray:
        """By row: lower state, then the episode with 1, 2, ... rows left, this one included; ``at`` is the row before."""
        out = np.empty((len(like), len(at)))
        for t in range(len(like)):
            now = out[t]
            if first and t == 0:
                now[:] = at
            else:
                now[0] = at[0] * (1 - self.leave) + at[1]
                now[1:-1] = at[2:]
                now[-1] = 0.0
                now[1:] += at[0] * self.leave * self.length
            now[0] *= like[t, 0]
            now[1:] *= like[t, 1]
            now /= now.sum()
            at = now
        return out

    def backward(self, like: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(by row what the rows after say of each place of ``forward``, the same for the row before); ``at`` is that of the last row."""
        out = np.empty((len(like), len(at)))
        for t in range(len(like) - 1, -1, -1):
            out[t] = at
            stay, up = like[t, 0] * at[0], like[t, 1] * at[1:]
            before = np.empty_like(at)
            before[0] = (1 - self.leave) * stay + self.leave * (self.length @ up)
            before[1] = stay
            before[2:] = up[:-1]
            at = before / max(before.max(), 1e-300)
        return out, at


    def sums(self, x: np.ndarray, post: np.ndarray) -> list[float]:
        """What a round needs of some rows: weight, sums and squares above, steps up and steps that stay below."""
        return [post.sum(), (post * x).sum(), (post * x * x).sum(), ((1 - post[:-1]) * post[1:]).sum(), ((1 - post[:-1]) * (1 - post[1:])).sum()]

    def posterior(self, x: np.ndarray, ahead: np.ndarray, first: bool, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of the upper state by row, ``backward``'s state for the row before)."""
        like = self.likelihoods(x)
        b, before = self.backward(like, behind)
        g = self.forward(like, ahead, first) * b
        return g[:, 1:].sum(1) / np.maximum(g.sum(1), 1e-300), before

    def refit(self, got: list[float]) -> None:
        w, wx, wxx, up, stay = got
        if w > 5:
            self.m1 = max(wx / w, self.m0 + 0.3 * self.s0)
            self.s1 = max(float(np.sqrt(max(wxx - 2 * self.m1 * wx + self.m1**2 * w, 0.0) / w)), 0.3 * self.s0)
        if up + stay > 1:
            self.leave = float(np.clip(up / (up + stay), 0.001, 0.3))


def lengths(n: int, rate: float, shortest: float, longest: float, mean_s: float, sd_s: float) -> np.ndarray:
    """Chances of 1, 2, ... rows: a normal length between ``shortest`` and ``longest`` seconds; short streams end at a third of theirs."""
    least = max(1, round(shortest * rate))
    most = max(least + 1, round(longest * rate))
    most = max(least + 1, n // 3) if n < 2 * most else most
    d = np.arange(1, most + 1)
    log_p = np.where(d >= least, -0.5 * ((d - mean_s * rate) / max(sd_s * rate, 0.5)) ** 2, -np.inf)
    p = np.exp(log_p - log_p.max())
    return p / p.sum()


def hsmm(
    rows: DataFrame, keys: Sequence[str], value: str, rate: float, null: DataFrame | None = None, fitted: DataFrame | None = None, shortest: float = 0.5, longest: float = 30.0, mean_s: float = 8.0,
    sd_s: float = 5.0, rounds: int = 10, chunk: int = chunks.CHUNK, run_in: int = chunks.RUN_IN,
) -> tuple[DataFrame, DataFrame]:
    """((keys, b, posterior), (keys, m0, s0, m1, s1, leave)): the upper of two states, whose stays have a truncated normal length.

    The lower state's mean and deviation stay: those of ``null`` (keys, m0, s0), else of the stream's own lower half.
    The upper one's and the chance to leave are fitted in ``rounds`` from the upper quarter on; with ``fitted``
    (such parameters) nothing is. Missing values are 0; streams of under 20 rows give 0. Any number of streams goes
    at once, so draws of a null are streams of their own. A round sums by chunk what the next parameters need.
    """
    by, kind, run_in = [*keys, "_span"], kinds(rows, keys), min(run_in, chunk)
    data = written(rows.select(*keys, F.col("b").cast("int").alias("b"), clean(value).alias("x")))
    streams = data.groupBy(*keys).agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("mid"), F.percentile("x", F.lit(0.75)).alias("upper")).where("n >= 20")
    names = ["m0", "s0", "m1", "s1", "leave"]
    if fitted is not None:
        params = streams.select(*keys, "n").join(fitted.select(*keys, *names), list(keys))
    else:
        met = data.join(streams, list(keys))
        if null is None:
            null = met.where("x <= mid").groupBy(*keys).agg(F.avg("x").alias("m0"), F.stddev_pop("x").alias("s0"))
        null = null.select(*keys, "m0", F.greatest("s0", F.lit(1e-8)).alias("s0"))
        above = lambda c: [F.count(F.when(F.col("x") > F.col(c), 1)).alias(f"n_{c}"), F.avg(F.when(F.col("x") > F.col(c), F.col("x"))).alias(f"m_{c}"), F.stddev_pop(F.when(F.col("x") > F.col(c), F.col("x"))).alias(f"s_{c}")]
        start = met.groupBy(*keys, "n").agg(*above("upper"), *above("mid")).join(null, list(keys))
        pick = lambda c, other: F.when(F.col("n_upper") >= 5, F.col(f"{c}_upper")).when(F.col("n_mid") >= 3, F.col(f"{c}_mid")).otherwise(other)
        m1 = F.greatest(pick("m", F.col("m0") + 2 * F.col("s0")), F.col("m0") + 0.3 * F.col("s0"))
        s1 = F.greatest(pick("s", F.col("s0")), 0.5 * F.col("s0"))
        params = start.select(*keys, "n", "m0", "s0", m1.alias("m1"), s1.alias("s1"), F.lit(float(np.clip(1 / (10 * rate), 0.001, 0.3))).alias("leave"))
    params = written(params)
    streams = written(streams.select(*keys, "low", "high").join(params.select(*keys), list(keys), "left_semi"))
    fit, shape = fitted is None, (rate, shortest, longest, mean_s, sd_s)
    turns = rounds if fit else 1

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        p, low = Episodes.row(r, *shape), int(r["low"])
        x = np.zeros(int(r["high"]) - low + 1)
        x[frame["b"].to_numpy() - low] = frame["x"].to_numpy()
        for _ in range(turns):
            post, _ = p.posterior(x, p.start(), True, np.ones(len(p.length) + 1))
            if fit:
                p.refit(p.sums(x, post))
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "begin": [low], "posterior": [post], "m0": [p.m0], "s0": [p.s0], "m1": [p.m1], "s1": [p.s1], "leave": [p.leave]})

    size = F.col("high") - F.col("low") + 1
    some = data.join(streams.where(size <= chunk), list(keys)).join(params, list(keys))
    short = written(some.groupBy(*keys).applyInPandas(whole, f"{kind}, begin int, posterior array<double>, m0 double, s0 double, m1 double, s1 double, leave double"))
    parts, fits = short.select(*keys, "begin", "posterior"), short.select(*keys, *names)
    if streams.where(size > chunk).limit(1).count():
        more, found = _long(data, streams.where(size > chunk), params, keys, shape, turns, fit, chunk, run_in)
        parts, fits = parts.union(more), fits.union(found)
    at = parts.select(*keys, "begin", F.posexplode("posterior").alias("_i", "posterior"))
    known = at.select(*keys, (F.col("begin") + F.col("_i")).cast("int").alias("b"), "posterior")
    # only rows that the stream has, and those of streams that are too short
    return data.select(*keys, "b").join(known, [*keys, "b"], "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0))), fits


def _long(data: DataFrame, streams: DataFrame, params: DataFrame, keys: Sequence[str], shape: tuple, turns: int, fit: bool, chunk: int, run_in: int) -> tuple[DataFrame, DataFrame]:
    """((keys, begin, posterior of a chunk), parameters) of streams of more than a chunk."""
    by, kind = [*keys, "_span"], kinds(data, keys)
    cut = written(spans.haloed(data.join(streams.select(*keys), list(keys), "left_semi"), run_in, run_in, chunk).drop("_own"))
    per = written(chunks.of(streams.select(*keys, "low", "high"), keys, chunk))

    def own(r) -> tuple[int, int, int, int]:  # noqa: ANN001
        """(first and last row of a stream, first and last of a chunk)."""
        low, high, span = int(r["low"]), int(r["high"]), int(r["_span"])
        return low, high, max(low, span * chunk), min(high, span * chunk + chunk - 1)

    def dense(frame: pd.DataFrame, begin: int, end: int) -> np.ndarray:
        x = np.zeros(end - begin + 1)
        some = frame[(frame["b"] >= begin) & (frame["b"] <= end)]
        x[some["b"].to_numpy() - begin] = some["x"].to_numpy()
        return x

    ahead_kind = f"{kind}, _span long, start array<double>, end array<double>"

    def ahead(frame: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(at):
            return pd.DataFrame(columns=chunks.columns(ahead_kind))
        r = at.iloc[0]
        p, (low, _, begin, end) = Episodes.row(r, *shape), own(r)
        state = p.start() if r["start"] is None else np.asarray(r["start"], float)
        if r["start"] is None and begin > low:
            state = p.forward(p.likelihoods(dense(frame, max(low, begin - run_in), begin - 1)), state, True)[-1]
        last = p.forward(p.likelihoods(dense(frame, begin, end)), state, begin == low)[-1]
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "_span": [r["_span"]], "start": [state], "end": [last]})

    back_kind = f"{kind}, _span long, begin int, start array<double>, end array<double>, posterior array<double>, sums array<double>"

    def back(frame: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(at):
            return pd.DataFrame(columns=chunks.columns(back_kind))
        r = at.iloc[0]
        p, (low, high, begin, end) = Episodes.row(r, *shape), own(r)
        state = np.ones(len(p.length) + 1) if r["start"] is None else np.asarray(r["start"], float)
        if r["start"] is None and end < high:
            _, state = p.backward(p.likelihoods(dense(frame, end + 1, min(high, end + run_in))), state)
        x = dense(frame, begin, end)
        post, before = p.posterior(x, np.asarray(r["forward"], float), begin == low, state)
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "_span": [r["_span"]], "begin": [begin], "start": [state], "end": [before], "posterior": [post], "sums": [p.sums(x, post)]})

    def runner(work, kind_, extra):  # noqa: ANN001, ANN202
        def run(starts: DataFrame) -> DataFrame:
            live = per.join(params, list(keys)).join(starts, by)
            live = live if extra is None else live.join(extra, by)
            return cut.join(starts.select(*by), by, "left_semi").groupBy(*by).cogroup(live.groupBy(*by)).applyInPandas(work, kind_)

        return run

    done = None
    for _ in range(turns):
        first = chunks.agreed(per, keys, runner(ahead, ahead_kind, None))
        before, done = done, chunks.agreed(per, keys, runner(back, back_kind, first.select(*by, F.col("start").alias("forward"))), later=True)
        dropped(first, *([before] if before is not None else []))
        if not fit:
            break
        # steps over the borders of chunks
        ends = done.select(*keys, (F.col("_span") + 1).alias("_span"), (1 - F.element_at("posterior", -1)).alias("low"))
        steps = done.select(*by, F.col("posterior")[0].alias("high")).join(ends, by).groupBy(*keys).agg(F.sum(F.col("low") * F.col("high")).alias("_up"), F.sum(F.col("low") * (1 - F.col("high"))).alias("_stay"))
        got = done.groupBy(*keys).agg(*[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(("w", "wx", "wxx", "up", "stay"))]).join(steps, list(keys), "left")
        both = params.join(got, list(keys))
        up, stay = F.col("up") + F.coalesce("_up", F.lit(0.0)), F.col("stay") + F.coalesce("_stay", F.lit(0.0))
        m1 = F.when(F.col("w") > 5, F.greatest(F.col("wx") / F.col("w"), F.col("m0") + 0.3 * F.col("s0"))).otherwise(F.col("m1"))
        spread = F.sqrt(F.greatest(F.col("wxx") - 2 * m1 * F.col("wx") + m1 * m1 * F.col("w"), F.lit(0.0)) / F.col("w"))
        s1 = F.when(F.col("w") > 5, F.greatest(spread, 0.3 * F.col("s0"))).otherwise(F.col("s1"))
        leave = F.when(up + stay > 1, F.least(F.greatest(up / (up + stay), F.lit(0.001)), F.lit(0.3))).otherwise(F.col("leave"))
        after = written(both.select(*keys, "n", "m0", "s0", m1.alias("m1"), s1.alias("s1"), leave.alias("leave")))
        params = after
    return done.select(*keys, "begin", "posterior"), params.join(streams.select(*keys), list(keys), "left_semi").select(*keys, "m0", "s0", "m1", "s1", "leave")


def hsmm_posterior(rows: DataFrame, keys: Sequence[str], value: str, rate: float, **options) -> DataFrame:
    """(keys, b, posterior) of ``hsmm``."""
    return hsmm(rows, keys, value, rate, **options)[0]


def hsmm_localization(rows: DataFrame, null: DataFrame, keys: Sequence[str], channel: str, value: str, rate: float, share: float = 0.1, smooth_s: float = 3.0, **options) -> tuple[DataFrame, DataFrame]:
    """((keys, b, z, posterior), (keys, m0, s0, m1, s1, leave, fraction, threshold, detected)): episodes in scores pooled over channels.

    ``rows`` (keys, channel, b, value), ``null`` with the draw ``k``. Values are scored by their draws' mean and
    deviation at their time, both smoothed over ``smooth_s``, and added up over the root of the number of channels.
    The lower state is what the draws' scores are. Draws then go through the fitted states in one pass, each a stream:
    ``detected`` if the fraction over 0.5 exceeds the 1 - ``share`` quantile of theirs.
    """
    by, half = [*keys, channel], max(1, int(smooth_s * rate)) // 2
    number = rows.select(*by, "b", clean(value).alias("v"))
    draws = null.select(*by, "k", "b", clean(value).alias("v"))
    stats = draws.groupBy(*by, "b").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    w = Window.partitionBy(*by, "_span").orderBy("b").rowsBetween(-half, half)
    flat = spans.own(spans.haloed(stats, half, half).withColumns({"_m": F.avg("_m").over(w), "_s": F.greatest(F.avg("_s").over(w), F.lit(1e-8))}))
    scored = lambda df, *more: df.join(flat, [*by, "b"]).groupBy(*keys, *more, "b").agg((F.sum((F.col("v") - F.col("_m")) / F.col("_s")) / F.sqrt(F.count("*"))).alias("z"))
    real, nulls = written(scored(number)), written(scored(draws, "k"))
    lower = nulls.groupBy(*keys).agg(F.avg("z").alias("m0"), F.greatest(F.stddev_pop("z"), F.lit(1e-6)).alias("s0"))
    post, params = hsmm(real, keys, "z", rate, null=lower, **options)
    chance = hsmm_posterior(nulls, [*keys, "k"], "z", rate, fitted=nulls.select(*keys, "k").distinct().join(params, list(keys)), **options)
    over = F.avg((F.col("posterior") > 0.5).cast("double")).alias("fraction")
    cut = chance.groupBy(*keys, "k").agg(over).groupBy(*keys).agg(F.percentile("fraction", F.lit(1 - share)).alias("threshold"))
    found = params.join(post.groupBy(*keys).agg(over), list(keys)).join(cut, list(keys)).withColumn("detected", F.col("fraction") > F.col("threshold"))
    return real.join(post, [*keys, "b"]), found


# Change points


def front(x: np.ndarray, at: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(the best last change before each row's end, live changes after the last row) of optimal partitioning with pruning.

    Changes are rows of (place, best cost up to it, sum and sum of squares from it on), places relative to
    the first row of ``x``. Only differences of costs matter, so the least is 0 in what is handed on.
    """
    place, best, s, q = (at[:, i].copy() for i in range(4))
    cuts = np.empty(len(x), np.int64)
    for t, v in enumerate(x):
        s = s + v
        q = q + v * v
        cost = best + q - s * s / (t + 1 - place)
        k = int(np.argmin(cost))
        cuts[t] = place[k]
        least = cost[k] + penalty
        keep = cost <= least
        place, best, s, q = np.append(place[keep], t + 1), np.append(best[keep], least), np.append(s[keep], 0.0), np.append(q[keep], 0.0)
    order = np.argsort(place)
    out = np.stack([place, best - best.min(), s, q], 1)[order]
    out[:, 0] -= len(x)
    return cuts, out


def pelt_segments(rows: DataFrame, keys: Sequence[str], value: str, chunk: int = chunks.CHUNK, run_in: int = 4 * chunks.RUN_IN) -> DataFrame:
    """(keys, b, segment, mean): change points of least squared error with a penalty of 2 ln n times the variance.

    A chunk carries the live changes over its border. Going back, each live change at a border tells through
    which one of the border before it goes, a few rows a chunk, and chunks then mark their own changes. Missing
    values are 0, and so are rows that a stream lacks.
    """
    by, kind, run_in = [*keys, "_span"], kinds(rows, keys), min(run_in, chunk)
    data = written(rows.select(*keys, F.col("b").cast("int").alias("b"), clean(value).alias("x")))
    streams = data.groupBy(*keys).agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n"), F.var_pop("x").alias("v"))
    streams = written(streams.select(*keys, "low", "high", (2 * F.log(F.greatest("n", F.lit(2))) * F.greatest("v", F.lit(1e-12))).alias("penalty")))
    cut = written(spans.haloed(data, run_in, 0, chunk).drop("_own"))
    per = written(chunks.of(streams, keys, chunk))
    out_kind = f"{kind}, _span long, begin int, start array<double>, end array<double>, cuts array<int>, live array<int>, through array<int>"

    def work(frame: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(at):
            return pd.DataFrame(columns=chunks.columns(out_kind))
        r = at.iloc[0]
        low, span, penalty = int(r["low"]), int(r["_span"]), float(r["penalty"])
        begin, end = max(low, span * chunk), min(int(r["high"]), span * chunk + chunk - 1)
        early = begin if r["start"] is not None else max(low, begin - run_in)
        x = np.zeros(end - early + 1)
        some = frame[frame["b"] >= early]
        x[some["b"].to_numpy() - early] = some["x"].to_numpy()
        state = np.array([[0.0, 0.0, 0.0, 0.0]]) if r["start"] is None else np.asarray(r["start"], float).reshape(-1, 4)
        if early < begin:
            _, state = front(x[: begin - early], state, penalty)
        cuts, live = front(x[begin - early :], state, penalty)
        n, through = end - begin + 1, []
        for place in live[:, 0].astype(int) + n:
            while place > 0:
                place = int(cuts[place - 1])
            through.append(begin + place)
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "_span": [span], "begin": [begin], "start": [state.ravel()], "end": [live.ravel()], "cuts": [cuts + begin], "live": [(live[:, 0].astype(int) + n + begin)], "through": [through]})

    def run(starts: DataFrame) -> DataFrame:
        live = per.join(starts, by)
        return cut.join(starts.select(*by), by, "left_semi").groupBy(*by).cogroup(live.groupBy(*by)).applyInPandas(work, out_kind)

    done = chunks.agreed(per, keys, run)

    def back(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_span", ascending=False)
        place, spans_, entries = int(frame["high"].iloc[0]) + 1, [], []
        for span, begin, live, through in zip(frame["_span"], frame["begin"], frame["live"], frame["through"]):
            if place > begin:
                spans_.append(span)
                entries.append(place)
                place = int(np.asarray(through)[np.flatnonzero(np.asarray(live) == place)[0]])
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(spans_) for k in keys}, "_span": spans_, "entry": entries})

    entries = done.select(*by, "begin", "live", "through").join(streams.select(*keys, "high"), list(keys)).groupBy(*keys).applyInPandas(back, f"{kind}, _span long, entry int")  # live changes of a chunk

    def marks(frames):
        for frame in frames:
            out = []
            for begin, cuts, place in zip(frame["begin"], frame["cuts"], frame["entry"]):
                mine = []
                while place > begin:
                    place = int(cuts[place - 1 - begin])
                    mine.append(place)
                out.append(mine)
            yield frame[list(keys)].assign(at=out)

    found = done.select(*by, "begin", "cuts").join(entries, by).select(*keys, "begin", "cuts", "entry").mapInPandas(marks, f"{kind}, at array<int>")
    changes = found.select(*keys, F.explode("at").alias("b")).distinct().withColumn("_new", F.lit(1))
    marked = data.join(changes, [*keys, "b"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    numbered = spans.running(marked, keys, ["b"], {"_s": ("sum", F.col("_new"))}, chunk).withColumn("segment", (F.col("_s") - 1).cast("int"))
    means = numbered.groupBy(*keys, "segment").agg(F.avg("x").alias("mean"))
    return numbered.select(*keys, "b", "segment").join(means, [*keys, "segment"]).select(*keys, "b", "segment", "mean")
