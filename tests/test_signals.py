"""Signal features on pure tones and hand-made beats; selection on planted sources."""

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lagweave.operators import analysis, selection, signals
from lagweave.plans import queries
from lagweave.sources import streams

RATE = 64.0


def tone(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"k": "s", "b": np.arange(n, dtype=np.int32), **columns}))


def test_filter_keeps_the_band_and_drops_the_rest(spark):
    t = np.arange(1024) / RATE
    inside, outside = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 25 * t)
    got = signals.filtered(tone(spark, x=inside + outside + 3), ["k"], "x", signals.butterworth(1, 12, RATE), 256, 128).toPandas().sort_values("b")["filtered"].to_numpy()
    assert len(got) == 1024 and np.abs(got - inside)[100:-100].max() < 0.15
    notched = signals.zero_phase(outside, [signals.biquad("notch", 25, RATE, 5)], 128)
    assert np.abs(notched[200:-200]).max() < 0.05


def test_power_and_coherence(spark):
    t = np.arange(512) / RATE
    r = np.random.default_rng(0)
    x = np.sin(2 * np.pi * 6 * t) + 0.1 * r.normal(size=512)
    y = np.sin(2 * np.pi * 6 * t - np.pi / 2) + 0.1 * r.normal(size=512)
    rows, bands = tone(spark, x=x, y=y), {"low": (5.0, 7.0), "high": (20.0, 30.0)}
    power = signals.band_power(rows, ["k"], "x", 128, 32, RATE, bands).toPandas()
    assert sorted(power["w"]) == list(range(13)) and (power["low"] > 20 * power["high"]).all()
    c = signals.band_coherence(rows, ["k"], "x", "y", 128, 32, RATE, bands).toPandas()
    assert c["low_msc"].mean() > 0.8 and c["low_imcoh"].mean() > 0.7 > c["high_msc"].mean()


def test_beats(spark):
    t = np.arange(0, 10, 0.01)
    x = sum(np.exp(-(((t - p) / 0.02) ** 2)) for p in np.arange(0.5, 10, 0.8))
    rows = spark.createDataFrame(pd.DataFrame({"k": "s", "t": t, "x": x}))
    found = signals.beats(rows, ["k"], "x")
    ibi = [r["ibi"] for r in found.orderBy("t").collect()]
    assert len(ibi) == 12 and ibi[0] is None and ibi[1:] == pytest.approx([0.8] * 11, abs=0.011)
    assert signals.heart_rate(found, ["k"], 5.0).orderBy(F.desc("t")).first()["hr"] == pytest.approx(75, abs=1)


def test_geometry_and_components(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>, c array<double>")
    got = row.select(signals.angle(F.col("a"), F.col("b"), F.col("c")).alias("x"), signals.distance(F.col("a"), F.col("c")).alias("d")).first()
    assert got["x"] == pytest.approx(np.pi / 2, abs=1e-6) and got["d"] == pytest.approx(5**0.5)
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 1)) * np.array([[3.0, 0.0, 3.0]]) + 0.1 * r.normal(size=(300, 3))
    df = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    load = signals.principal_components(df, "v", 3, 1)
    assert load[0] == pytest.approx([0.5**0.5, 0, 0.5**0.5], abs=0.02)
    assert signals.project(df, "v", load).agg(F.stddev("pc0")).first()[0] > 3


def test_selection_agrees_on_planted_groups(spark):
    r = np.random.default_rng(2)
    cols = {f"x{i}": r.normal(size=480) for i in range(8)}
    y = 0.8 * cols["x1"] - 0.8 * cols["x4"] + 0.4 * r.normal(size=480)
    rows, names = tone(spark, y=y, **cols), list(cols)
    stable = selection.stability(rows, ["k"], names, names, "y", 0.25, 8)
    block = selection.blocks(rows, ["k"], names, names, "y", 0.3, 60)
    out = selection.decide(stable, block, ["k"]).first()
    assert out["selected"] == ["x1", "x4"] and out["p_overlap"] < 0.05
    hc = spark.createDataFrame([("f", f"t{i}", p) for i, p in enumerate([0.001, 0.002, 0.5, 0.9])], "f string, n string, p double")
    assert selection.higher_criticism(hc, ["f"], ["n"]).first()["hc"] > 5
    moved = selection.block_shuffle(tone(spark, x=np.arange(40.0)), ["k"], 8, 1)
    assert sorted(x["x_shuffled"] for x in moved.collect()) == list(map(float, range(40)))


def test_whole_analysis(spark):
    out = analysis.analyze(streams.samples(spark, SMALL), ["modality"], analysis.Config().merged(excluded=("view",)))
    assert out.count() == 12 and {"dr2", "p_adjusted", "significant"} <= set(out.columns)


def test_embedding_components_are_those_of_all_channels(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.array(vectors["embedding"].tolist(), float)
    assert x.shape[1] == 64
    load = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :3]
    load *= np.sign(load[np.abs(load).argmax(0), range(3)])
    got = queries.QUERIES["embedding_components"](spark, SMALL).toPandas().sort_values("vec_id")[["pc0", "pc1", "pc2"]].to_numpy()
    assert got == pytest.approx(x @ load, abs=1e-5)
