"""Preparation and screening of targets: trends, own past, matched cross-covariances, surrogate tests.

Everything leaves Catalyst as sums by key, so a test of many shifts costs one aggregate; only matrices
of a few rows and columns are solved in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators.regression import moments, square
from lagweave.operators.surrogates import empirical_p, null_z
from lagweave.sources.shared import written


def _kinds(rows: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)


def detrended(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``detrended``: the value less its parabola over b. Each key has the rows 0 to n - 1."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    u = F.col("b") - (F.col("_n") - 1) / 2
    at = rows.join(n, list(keys)).withColumns({"_p1": u, "_p2": u * u - (F.col("_n") * F.col("_n") - 1) / 12})  # orthogonal on the grid
    fit = lambda p: F.sum(F.col(value) * F.col(p)) / F.sum(F.col(p) * F.col(p))
    line = at.groupBy(*keys).agg(F.avg(value).alias("_c0"), F.coalesce(fit("_p1"), F.lit(0.0)).alias("_c1"), F.coalesce(F.when(F.sum(F.col("_p2") * F.col("_p2")) > 0, fit("_p2")), F.lit(0.0)).alias("_c2"))
    return at.join(line, list(keys)).withColumn("detrended", F.col(value) - F.col("_c0") - F.col("_c1") * F.col("_p1") - F.col("_c2") * F.col("_p2")).drop("_n", "_p1", "_p2", "_c0", "_c1", "_c2")


def whitened(rows: DataFrame, keys: Sequence[str], value: str, past: Sequence[str], lam: float = 1e-3) -> DataFrame:
    """``rows`` with ``residual``: what ridge on the columns ``past`` leaves of the value."""
    p = len(past) + 1

    def solve(frames):
        for frame in frames:
            w = []
            for g in frame["gram"]:
                m = square(g, p)
                w.append(np.linalg.solve(m[:-1, :-1] + lam * np.eye(p - 1), m[:-1, -1]))
            yield frame[list(keys)].assign(_w=w)

    solved = moments(rows, keys, [*past, value]).mapInPandas(solve, f"{_kinds(rows, keys)}, _w array<double>")
    fit = sum((F.col("_w")[i] * F.col(c) for i, c in enumerate(past)), F.lit(0.0))
    return rows.join(solved, list(keys)).withColumn("residual", F.col(value) - fit).drop("_w")


def matched_cross(rows: DataFrame, keys: Sequence[str], basis: Sequence[str], residual: str) -> DataFrame:
    """(keys, cc, norm2): mean products of each basis column and the residual, and their squared length."""
    out = rows.groupBy(*keys).agg(F.array(*[F.avg(F.col(c) * F.col(residual)) for c in basis]).alias("cc"))
    return out.withColumn("norm2", F.aggregate("cc", F.lit(0.0), lambda a, x: a + x * x))


def matched_screen(rows: DataFrame, keys: Sequence[str], channel: str, basis: Sequence[str], residual: str, draw: str = "k") -> DataFrame:
    """(keys, total, largest, upper, max_z, p): matched cross-covariances of all channels against shifted ones.

    ``rows`` has the draw ``k`` (-1 is real). Covariances are whitened by the mean moments of the basis
    over channels and draw -1; their squared lengths give the sum, the largest, and the sum of the top
    third of channels (one at least). Each is scored against its shifts, and p is that of the largest score.
    """
    nb = len(basis)
    sums = moments(rows, [*keys, draw, channel], [*basis, residual])
    gram = sums.where(F.col(draw) == -1).groupBy(*keys).agg(F.array(*[F.avg(F.col("gram")[i] / F.col("n")) for i in range((nb + 1) * (nb + 2) // 2)]).alias("_g"))

    def solve(frames):
        for frame in frames:
            s = []
            for g, n, mean in zip(frame["gram"], frame["n"], frame["_g"]):
                values, vectors = np.linalg.eigh(square(mean, nb + 1)[:-1, :-1])
                s.append(float(np.sum((vectors.T @ (square(g, nb + 1)[:-1, -1] / n)) ** 2 / np.maximum(values, 1e-8))))
            yield frame[[*keys, draw, channel]].assign(s=s)

    each = sums.join(gram, list(keys)).mapInPandas(solve, f"{_kinds(rows, [*keys, draw, channel])}, s double")
    w = Window.partitionBy(*keys, draw)
    ranked = each.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("s"), channel)), "_c": F.count("*").over(w)})
    stats = ranked.groupBy(*keys, draw).agg(F.sum("s").alias("total"), F.max("s").alias("largest"), F.sum(F.when(F.col("_r") <= F.greatest(F.floor(F.col("_c") / 3), F.lit(1)), F.col("s"))).alias("upper"))
    names = ["total", "largest", "upper"]
    long = stats.select(*keys, draw, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("stat")) for i, c in enumerate(names)])).alias("s")).select(*keys, draw, "s.*")
    scored = null_z(long, long.where(F.col(draw) >= 0), [*keys, "which"])
    tops = scored.groupBy(*keys, draw).agg(F.max("z").alias("top"))
    real, null = tops.where(F.col(draw) == -1).select(*keys, F.col("top").alias("max_z")), tops.where(F.col(draw) >= 0)
    tested = null.join(real, list(keys)).groupBy(*keys, "max_z").agg(((F.sum((F.col("top") >= F.col("max_z")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))
    return stats.where(F.col(draw) == -1).drop(draw).join(tested, list(keys))


def svd_screen(cross: DataFrame, keys: Sequence[str], row: str, column: str, value: str, draw: str = "k") -> DataFrame:
    """(keys, sigma, p): the leading singular value of a cross-covariance table against those of its shifts."""

    def lead(frame: pd.DataFrame) -> pd.DataFrame:
        m = frame.pivot_table(index=row, columns=column, values=value, aggfunc="sum", fill_value=0.0).to_numpy()
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in (*keys, draw)}, "sigma": [float(np.linalg.svd(m, compute_uv=False)[0])]})

    each = cross.groupBy(*keys, draw).applyInPandas(lead, f"{_kinds(cross, [*keys, draw])}, sigma double")  # features by targets of one draw
    real, null = each.where(F.col(draw) == -1).drop(draw), each.where(F.col(draw) >= 0).withColumnRenamed("sigma", "_s")
    met = null.join(real, list(keys)) if keys else null.crossJoin(F.broadcast(real))
    return met.groupBy(*keys, "sigma").agg(((F.sum((F.col("_s") >= F.col("sigma")).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def leading_value(cross: DataFrame, keys: Sequence[str], row: str, column: str, value: str, rank: int = 8, turns: int = 2) -> DataFrame:
    """(keys, sigma): the leading singular value of each key's table (row, column, value), by a randomised range finder.

    Random signs by hash mix the columns into ``rank`` ones; products with the table and its transpose, ``turns`` times
    each, are grouped sums, and only Gram matrices of ``rank`` columns leave them. Exact where a side has no more than
    ``rank`` entries; absent cells are 0.
    """
    kinds = _kinds(cross, keys)

    def times(vectors: DataFrame, by: str, to: str) -> DataFrame:
        """(keys, to, v): the table times (keys, by, v)."""
        return cross.join(vectors, [*keys, by]).groupBy(*keys, to).agg(F.array(*[F.sum(F.col(value) * F.col("v")[i]) for i in range(rank)]).alias("v"))

    def grams(vectors: DataFrame) -> DataFrame:
        return vectors.groupBy(*keys).agg(F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(rank) for j in range(i, rank)]).alias("gram"))

    def turns_of(frames):
        for frame in frames:
            out = []
            for g in frame["gram"]:
                size, vectors = np.linalg.eigh(square(g, rank))
                keep = size > max(size[-1], 0.0) * 1e-12
                out.append((vectors * np.where(keep, 1 / np.sqrt(np.where(keep, size, 1.0)), 0.0)).ravel())
            yield frame[list(keys)].assign(_t=out)

    def orthonormal(vectors: DataFrame, by: str) -> DataFrame:
        vectors = written(vectors)  # it is read twice
        turned = vectors.join(grams(vectors).mapInPandas(turns_of, f"{kinds}, _t array<double>"), list(keys))
        return turned.select(*keys, by, F.array(*[sum((F.col("v")[i] * F.col("_t")[i * rank + j] for i in range(rank)), F.lit(0.0)) for j in range(rank)]).alias("v"))

    signs = F.array(*[F.when(F.shiftright(F.xxhash64(column), i) % 2 == 0, 1.0).otherwise(-1.0) for i in range(rank)])
    start = cross.select(*keys, column).distinct().withColumn("v", signs)
    basis = orthonormal(times(start, column, row), row)
    for _ in range(turns):
        basis = orthonormal(times(orthonormal(times(basis, row, column), column), column, row), row)

    def largest(frames):
        for frame in frames:
            yield frame[list(keys)].assign(sigma=[float(np.sqrt(max(np.linalg.eigvalsh(square(g, rank))[-1], 0.0))) for g in frame["gram"]])

    return grams(times(basis, row, column)).mapInPandas(largest, f"{kinds}, sigma double")


def targeted_svd(cross: DataFrame, candidates: DataFrame, keys: Sequence[str], row: str, column: str, value: str, draw: str = "k", **options) -> DataFrame:
    """(keys, sigma, n_null, p): the leading singular value of the candidates' cross-covariances against those of their shifts.

    ``cross`` (keys, draw, row, column, value), draw -1 is real; ``candidates`` (keys, row).
    """
    some = written(cross.join(candidates.select(*keys, row).distinct(), [*keys, row], "left_semi"))
    sigma = leading_value(some, [*keys, draw], row, column, value, **options).withColumn("sigma", F.round("sigma", 9))
    return empirical_p(sigma.where(F.col(draw) < 0).drop(draw), sigma.where(F.col(draw) >= 0).drop(draw), keys, "sigma")


def gradient_screen(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], groups: Sequence[str], residual: str) -> DataFrame:
    """(keys, grp, gradient, rank): the groups of largest mean product with the residual: half of them, 5 to 20."""
    sums = rows.groupBy(*keys).agg(*[F.avg(F.col(c) * F.col(residual)).alias(c) for c in columns])
    names = list(dict.fromkeys(groups))
    size = lambda g: F.sqrt(sum((F.col(c) * F.col(c) for c, x in zip(columns, groups) if x == g), F.lit(0.0)))
    each = sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.round(size(g), 9).alias("gradient")) for g in names])).alias("g")).select(*keys, "g.*")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gradient"), "grp")))
    return ranked.where(F.col("rank") <= min(20, max(5, len(names) // 2)))


def over_targets(found: DataFrame, keys: Sequence[str], target: str, share: str, hit: str, least: int = 1) -> DataFrame:
    """(keys, share, n_targets, selected): per-target selections joined: the largest share, and how many targets have it."""
    return found.groupBy(*keys).agg(F.max(share).alias("share"), F.sum(F.col(hit).cast("int")).alias("n_targets")).withColumn("selected", F.col("n_targets") >= least)
