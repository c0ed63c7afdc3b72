"""Shuffled streams against the batch filter and a plain walk."""

import numpy as np
import pandas as pd

from lagweave.operators.switching import Regimes, State, filtered
from lagweave.streaming import ordered


def replay(spark, tmp_path, df, build):
    """Five files in turn; within the delay rows come in any order."""
    path = str(tmp_path / "in")
    df.coalesce(1).sortWithinPartitions("file").drop("file").write.option("maxRecordsPerFile", 24).parquet(path)
    stream = spark.readStream.schema(df.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(stream).writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("ordered").toPandas()


def shuffled(n, r, block=6):
    """Places of arrival: rows move within blocks only."""
    return np.concatenate([r.permutation(np.arange(a, min(a + block, n))) for a in range(0, n, block)])


def test_forward_filter_equals_the_batch_one(spark, tmp_path):
    r = np.random.default_rng(4)
    n, c, nb = 120, 2, 2
    y, z = r.normal(size=(c, n)), r.normal(size=(c, n, nb))
    p = Regimes(np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([1.0, 0.8]), np.array([0.6, 0.5]), np.array([1.0, 0.9]))
    want, _, _ = filtered(y, z, np.ones(n, bool), p, State.start(p.own, nb), 1e-5, 0.0, True)
    at = np.argsort(shuffled(n, r))
    times = pd.date_range("2024-01-01", periods=n, freq="min")
    rows = pd.DataFrame({"s": "k", "ts": times, "values": [[*map(float, (*y[:, t], *z[:, t].ravel()))] for t in range(n)], "file": at})
    got = replay(spark, tmp_path, spark.createDataFrame(rows, "s string, ts timestamp, values array<double>, file long"), lambda s: ordered.switching(s, "s", "10 minutes", p, nb)).sort_values("ts")
    assert len(got) >= n - 12 and np.allclose(got["posterior"], want[: len(got), 1], atol=1e-9)


def test_conditions_follow_their_markers(spark, tmp_path):
    r = np.random.default_rng(6)
    n = 120
    marks = r.choice([0, 0, 0, 1, -1], n)
    times = pd.date_range("2024-01-01", periods=n, freq="min")
    rows = pd.DataFrame({"who": np.where(np.arange(n) % 2, "a", "b"), "ts": times, "mark": marks, "file": np.argsort(shuffled(n, r))})
    got = replay(spark, tmp_path, spark.createDataFrame(rows, "who string, ts timestamp, mark long, file long"), lambda s: ordered.condition(s, "who", "10 minutes"))
    want, on = {}, {"a": 0.0, "b": 0.0}
    for who, ts, mark in zip(rows["who"], times, marks):
        if mark:
            on[who] = float(mark > 0)
        else:
            want[who, ts] = on[who]
    found = {(a, b): v for a, b, v in zip(got["who"], got["ts"], got["active"])}
    assert len(found) >= len(want) - 12 and all(want[k] == v for k, v in found.items())
