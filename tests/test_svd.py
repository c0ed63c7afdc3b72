"""Leading singular values by sums against numpy."""

import numpy as np

from lagweave.operators import screening


def test_leading_values_equal_the_decomposition(spark):
    r = np.random.default_rng(1)
    wide = r.normal(size=(30, 3)) @ r.normal(size=(3, 40)) + 0.01 * r.normal(size=(30, 40))
    tables = {"small": r.normal(size=(3, 9)), "wide": wide, "zero": np.zeros((2, 2))}
    rows = [(name, i, f"t{j}", float(m[i, j])) for name, m in tables.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    got = {x["key"]: x["sigma"] for x in screening.leading_value(spark.createDataFrame(rows, "key string, f int, t string, c double"), ["key"], "f", "t", "c").collect()}
    assert set(got) == set(tables)
    for name, m in tables.items():
        assert np.isclose(got[name], np.linalg.svd(m, compute_uv=False)[0], rtol=1e-6, atol=1e-9)


def test_only_candidates_are_tested(spark):
    r = np.random.default_rng(2)
    rows = [("p", k, i, t, float(r.normal() + (5 if k < 0 and i == 1 else 9 if i == 2 else 0))) for k in range(-1, 19) for i in range(3) for t in range(4)]
    cross = spark.createDataFrame(rows, "path string, k int, f int, t int, c double")
    one = screening.targeted_svd(cross, spark.createDataFrame([("p", 1)], "path string, f int"), ["path"], "f", "t", "c").first()
    assert one["p"] == 0.05 and one["n_null"] == 19
    assert screening.targeted_svd(cross, spark.createDataFrame([("p", 2)], "path string, f int"), ["path"], "f", "t", "c").first()["p"] > 0.05
