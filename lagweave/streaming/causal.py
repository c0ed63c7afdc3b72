"""Causal operators on Structured Streaming: what the batch operators give without the future.

Rows are (modality, ts, x). A micro-batch is worked in order of time for each key; a row earlier than
the last one of the batches before is late and left out, so states never go back (``ordered`` waits for
such rows). Replaying a bounded input in order gives the batch operator's causal result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lagweave.sources.shared import shared_folder


def grid_bins(rows: DataFrame, width: str, delay: str) -> DataFrame:
    """(modality, start, x, n): tumbling means; rows later than ``delay`` behind are left out."""
    bins = rows.withWatermark("ts", delay).groupBy(F.window("ts", width), "modality").agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    return bins.select("modality", F.col("window.start").alias("start"), "x", "n")


def sliding_means(rows: DataFrame, width: str, step: str, delay: str) -> DataFrame:
    """(modality, start, x): means over overlapping windows, as for sliding coherence."""
    bins = rows.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "modality").agg(F.avg("x").alias("x"))
    return bins.select("modality", F.col("window.start").alias("start"), "x")


def _stateful(rows: DataFrame, out: str, state: str, first: tuple, step: Callable[[tuple, float], tuple[tuple, float]]) -> DataFrame:
    """(modality, ts, out): ``step`` takes the state and a value and gives the next state and a result; late rows are left out."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        *now, last = kept.get if kept.exists else (*first, None)
        now = tuple(now)
        frame = pd.concat(frames).sort_values("ts", kind="stable")
        if last is not None:
            frame = frame[frame["ts"] >= pd.Timestamp(last)]
        got = []
        for x in frame["x"].tolist():
            now, value = step(now, x)
            got.append(value)
        if len(frame):
            kept.update((*now, frame["ts"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"modality": key[0], "ts": frame["ts"], out: got})

    return rows.select("modality", "ts", "x").groupBy("modality").applyInPandasWithState(work, f"modality string, ts timestamp, {out} double", f"{state}, last timestamp", "append", GroupStateTimeout.NoTimeout)


def cusum(rows: DataFrame, centre: float, slack: float = 0.0) -> DataFrame:
    """``forward``: max(0, C + x - centre - slack) from 0, the first value giving 0."""

    def step(now: tuple, x: float) -> tuple[tuple, float]:
        c = max(0.0, now[0] + x - centre - slack) if now[1] else 0.0
        return (c, True), c

    return _stateful(rows, "forward", "c double, begun boolean", (0.0, False), step)


def activity(rows: DataFrame, width: int) -> DataFrame:
    """``activity``: mean size of the last ``width`` values, this one included."""

    def step(now: tuple, x: float) -> tuple[tuple, float]:
        ring = [*now[0], abs(x)][-width:]
        return (ring,), sum(ring) / len(ring)

    return _stateful(rows, "activity", "ring array<double>", ([],), step)


def ewma(rows: DataFrame, gamma: float) -> DataFrame:
    """``mean``: exponentially weighted mean so far; older values count ``gamma`` times less each step."""

    def step(now: tuple, x: float) -> tuple[tuple, float]:
        n, s = gamma * now[0] + 1, gamma * now[1] + x
        return (n, s), s / n

    return _stateful(rows, "mean", "n double, s double", (0.0, 0.0), step)


def replayed(spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame], value: str = "value") -> DataFrame:
    """``work`` on an events table read as a stream, (modality, ts, x: its column ``value``), run to its end into a table of the shared folder."""
    out = f"{shared_folder(spark)}/lagweave-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    events = reader.parquet(path).select(F.col("event_type").alias("modality"), F.col("ts").cast("timestamp").alias("ts"), F.col(value).alias("x"))
    made = work(events)
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
