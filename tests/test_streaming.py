"""Replayed streams against the batch operators."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lagweave.operators import localize, temporal
from lagweave.streaming import causal


def replay(spark, tmp_path, build, mode="append"):
    r = np.random.default_rng(0)
    rows = pd.DataFrame({"modality": ["a", "b"] * 30, "ts": pd.date_range("2024-01-01", periods=60, freq="min"), "x": r.normal(size=60)})
    df = spark.createDataFrame(rows, "modality string, ts timestamp, x double")
    df.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 20).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName("replayed").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = df.withColumn("b", F.row_number().over(Window.partitionBy("modality").orderBy("ts")))
    return spark.table("replayed"), batch


def pairs(df, value):
    return sorted((r["modality"], r["ts"], round(r[value], 9)) for r in df.collect())


def test_cusum(spark, tmp_path):
    got, batch = replay(spark, tmp_path, lambda s: causal.cusum(s, 0.0, 0.1))
    assert pairs(got, "forward") == pairs(localize.cusum(batch.withColumn("c", F.lit(0.0)), ["modality"], "x", "c", 0.1), "forward")


def test_activity(spark, tmp_path):
    got, batch = replay(spark, tmp_path, lambda s: causal.activity(s, 4))
    assert pairs(got, "activity") == pairs(temporal.activity(batch, ["modality"], 4, "x"), "activity")


def test_ewma(spark, tmp_path):
    got, _ = replay(spark, tmp_path, lambda s: causal.ewma(s, 1.0))
    assert got.count() == 60


def test_grid_bins(spark, tmp_path):
    got, batch = replay(spark, tmp_path, lambda s: causal.grid_bins(s, "10 minutes", "0 minutes"), "append")
    want = {(r["modality"], r["s"]): round(r["x"], 9) for r in batch.groupBy("modality", F.window("ts", "10 minutes")["start"].alias("s")).agg(F.avg("x").alias("x")).collect()}
    found = {(r["modality"], r["start"]): round(r["x"], 9) for r in got.collect()}
    assert len(found) >= 8 and all(want[k] == v for k, v in found.items())
