"""A stored run: what is planted is found in its direction, stages are made once, and odd sessions do no harm."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import coupling
from lagweave.sources import results

KIND = "session_id int, participant string, modality string, channel int, t double, x double"


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(7)
    n, rows = 240, []
    for session in (1, 2):
        lead = r.normal(size=(2, n))
        for c in range(2):
            own = r.normal(size=n)
            follow = np.concatenate([[0.0], lead[c][:-1]]) * 1.5 + r.normal(0, 0.6, n) if session == 1 else r.normal(size=n)
            for modality, p1, p2 in (("face", lead[c], follow), ("body", own, r.normal(size=n))):
                rows += [(session, p, modality, c, float(t), float(v)) for p, x in (("p1", p1), ("p2", p2)) for t, v in enumerate(x)]
    rows += [(3, "p1", "face", 0, float(t), 1.0) for t in range(30)]  # nobody else there
    return spark.createDataFrame(rows, KIND)


CONFIG = coupling.RunConfig(bin_s=1.0, n_basis=2, max_lag=4.0, ar_order=2, alpha=0.3, least_score=0.1, n_shifts=19, min_n=10, min_dr2=0.01, min_fraction=0.2)


@pytest.mark.parametrize("matched", [True, False])
def test_planted_coupling_is_found_in_its_direction(spark, samples, tmp_path, matched):
    out = coupling.analyze_both(samples, str(tmp_path), CONFIG.merged(matched=matched, detector="hmm" if matched else "share"))
    got = {(r["session_id"], r["direction"], r["src"], r["tgt"]): r for r in out["pathways"].collect()}
    assert len(got) == 2 * 2 * 4
    hit = got[1, "p1-p2", "face", "face"]
    assert hit["found"] and hit["significant"] and hit["mean_dr2"] > 0.1
    assert max(got.values(), key=lambda r: r["mean_dr2"] or 0.0) == hit
    assert out["meta"].where("session_id = 1 and direction = 'p1-p2'").first()["n_significant"] >= 1
    live = {tuple(r) for r in out["series"].select("session_id", "direction", "src", "tgt").distinct().collect()}
    assert (1, "p1-p2", "face", "face") in live and len(live) < len(got)  # only what passed the screen
    again = results.load_result(spark, str(tmp_path), "pathways", "1", "p1-p2")
    assert again.count() == 4


def test_stages_are_made_once(spark, samples, tmp_path):
    path = str(tmp_path)
    coupling.analyze_both(samples, path, CONFIG.merged(detector="share", matched=False))
    (mark,) = os.listdir(f"{path}/_stages")
    before = {n: os.path.getmtime(f"{path}/_stages/{mark}/{n}/_SUCCESS") for n in os.listdir(f"{path}/_stages/{mark}")}
    assert set(before) == {"signals", "source", "target", "found", "screened", "series", "decided"}
    out = coupling.analyze_both(samples.limit(0), path, CONFIG.merged(detector="share", matched=False))  # all stages are there
    assert before == {n: os.path.getmtime(f"{path}/_stages/{mark}/{n}/_SUCCESS") for n in before} and out["pathways"].count() == 16


def test_run_of_nothing(spark, samples, tmp_path):
    out = coupling.analyze_both(samples.limit(0), str(tmp_path), CONFIG)
    assert {n: df.count() for n, df in out.items()} == {"pathways": 0, "series": 0, "discovery": 0, "meta": 0}


def test_nonlinear_and_moderated_columns(spark, tmp_path):
    r = np.random.default_rng(9)
    n = 260
    x, m = r.normal(size=n), r.normal(size=n)
    y = {"square": np.concatenate([[0.0], x[:-1] ** 2 - 1]), "product": np.concatenate([[0.0], x[:-1]]) * m}
    rows = []
    for s, (_, v) in enumerate(y.items()):
        rows += [(s, p, mod, 0, float(t), float(z)) for p, mod, a in (("p1", "a", x), ("p2", "b", v + r.normal(0, 0.3, n)), ("p2", "m", m), ("p1", "m", r.normal(size=n))) for t, z in enumerate(a)]
    base = coupling.RunConfig(bin_s=1.0, n_basis=4, max_lag=4.0, ar_order=1, alpha=1.1, least_score=0.0, n_shifts=9, min_n=10, matched=False, detector="share", gamma=0.99)
    mean = {}
    for name, config in {"plain": base, "squares": base.merged(nonlinear=True), "moderated": base.merged(moderator="m")}.items():
        out = coupling.analyze_both(spark.createDataFrame(rows, KIND), f"{tmp_path}/{name}", config)["series"]
        for q in out.where("direction = 'p1-p2' and src = 'a' and tgt = 'b'").groupBy("session_id").agg(F.percentile("dr2", F.lit(0.5)).alias("d")).collect():
            mean[name, q["session_id"]] = q["d"]
    assert mean["squares", 0] > mean["plain", 0] + 0.1 and mean["moderated", 1] > mean["plain", 1] + 0.1
