"""Streams worked in order of event time, whatever order they arrive in: a forward switching filter, conditions.

A key's rows wait in its state until the watermark has passed them, then they are worked in order. So the buffer
holds no more than the rows of the delay, an event-time timer frees it when no rows come, and what arrives
within the delay is in its place; what is later than that Spark drops. Rows newer than the last watermark
stay in the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lagweave.operators.switching import Regimes, State, filtered


def in_order(rows: DataFrame, key: str, delay: str, width: int, out: str, first: Sequence[float], step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float | None]]) -> DataFrame:
    """(key, ts, out): ``step`` takes the state and a row's values and gives the next state and a result, or None for no row.

    ``rows`` (key, ts, values: array of ``width`` doubles). States are arrays of doubles. Equal times keep
    the order of their values.
    """
    kind = rows.schema[key].dataType.simpleString()

    def work(own: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now, times, values = kept.get if kept.exists else (list(first), [], [])
        now, times, values = np.asarray(now, float), np.asarray(times, np.int64), np.asarray(values, float).reshape(-1, width)
        for frame in [] if kept.hasTimedOut else frames:
            times = np.concatenate([times, frame["us"].to_numpy(np.int64)])
            values = np.concatenate([values, np.stack(frame["values"].to_numpy()).astype(float).reshape(-1, width)])
        order = np.lexsort((*values.T[::-1], times))
        times, values, mark = times[order], values[order], kept.getCurrentWatermarkMs()
        ready = int(np.searchsorted(times, mark * 1000, side="right"))
        at, got = [], []
        for t, v in zip(times[:ready], values[:ready]):
            now, value = step(now, v)
            if value is not None:
                at.append(t)
                got.append(value)
        kept.update((now.tolist(), times[ready:].tolist(), values[ready:].ravel().tolist()))
        if ready < len(times):
            kept.setTimeoutTimestamp(max(int(times[ready]) // 1000, mark) + 1)
        yield pd.DataFrame({key: [own[0]] * len(at), "ts": pd.to_datetime(np.array(at, np.int64), unit="us"), out: np.array(got, float)})

    given = rows.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("us"), "values")
    return given.groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, ts timestamp, {out} double", "now array<double>, times array<long>, held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def switching(rows: DataFrame, key: str, delay: str, regimes: Regimes, nb: int, drift: float = 1e-5, penalty: float = 0.0) -> DataFrame:
    """(key, ts, posterior): the probability of regime 1 given all rows so far, with regimes fitted beforehand.

    ``rows`` (key, ts, values): each channel's residual, then each channel's ``nb`` sources, as the batch filter prepares them.
    """
    c = len(regimes.own)

    def step(now: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
        xi, _, state = filtered(v[:c, None], v[c:].reshape(c, 1, nb), np.ones(1, bool), regimes, State.of(now[1:], c, nb), drift, penalty, now[0] == 0)
        return np.concatenate([[1.0], state.flat()]), float(xi[0, 1])

    return in_order(rows, key, delay, c * (nb + 1), "posterior", [0.0, *State.start(regimes.own, nb).flat()], step)


def condition(rows: DataFrame, key: str, delay: str) -> DataFrame:
    """(key, ts, active): of each sample whether a condition holds; ``rows`` (key, ts, mark: 1 starts, -1 stops, 0 or null is a sample)."""

    def step(now: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float | None]:
        return (np.array([float(v[0] > 0)]), None) if v[0] else (now, float(now[0]))

    at = rows.select(key, "ts", F.array(F.coalesce(F.col("mark").cast("double"), F.lit(0.0))).alias("values"))
    return in_order(at, key, delay, 1, "active", [0.0], step)
