"""Further queries over the driver tables: wavelets, screening, decisions, pairs of people and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators import discovery, pairs, regression, screening, signals, stage2, surrogates, temporal, wavelets
from lagweave.plans.queries import ACT, ASOF, BASIS, CH, EV, M, PAIRS, R, SHIFTED, STAT, Z, _MODS, _VALUES, _fourier, _wide, design, pair_rows, query, r6, rounded, shifted, zgrid
from lagweave.sources import streams
from lagweave.streaming import causal


def values(name: str, weights: dict) -> str:
    """A CTE of lag weights; complex ones as two columns."""
    rows = ", ".join(f"({k}, {v.real!r}::DOUBLE, {v.imag!r}::DOUBLE)" if isinstance(v, complex) else f"({k}, {v!r}::DOUBLE)" for k, v in weights.items())
    return f"{name}(lag, re, im) AS (VALUES {rows})" if isinstance(next(iter(weights.values())), complex) else f"{name}(lag, w) AS (VALUES {rows})"


W6 = wavelets.morlet(0.5, 4.0, 5.0)
ANALYTIC = Z + f""", {values("wv", W6)}, an AS (SELECT g.modality, g.b, sum(re * coalesce(h.z, 0.0)) AS re, sum(im * coalesce(h.z, 0.0)) AS im FROM z g CROSS JOIN wv LEFT JOIN z h ON h.modality = g.modality AND h.b = g.b - lag GROUP BY ALL)"""


def analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelets.analytic(zgrid(spark, sf_dir), M, "z", 4.0, (0.5,)).withColumnsRenamed({"re0": "re", "im0": "im"})


@query(f"WITH {ANALYTIC} SELECT modality, b, {R('re * re + im * im')} AS power FROM an")
def morlet_band(spark, sf_dir):
    return wavelets.morlet_power(zgrid(spark, sf_dir), M, "z", 4.0, (0.5,)).select("modality", "b", r6(F.col("power")[0]).alias("power"))


@query(f"WITH {Z}, {values('g', wavelets.gaussian(2.0))} SELECT c.modality, c.b, {R('sum(w * h.z) / sum(w)')} AS smooth FROM z c CROSS JOIN g JOIN z h ON h.modality = c.modality AND h.b = c.b - lag GROUP BY ALL")
def gaussian_smooth(spark, sf_dir):
    return rounded(wavelets.smoothed(zgrid(spark, sf_dir), M, "z", 2.0).select("modality", "b", "smooth"), "smooth")


@query(
    f"""WITH {Z}, {values("g", wavelets.low_pass(3))} SELECT c.modality, CAST(c.b // 3 AS INT) AS b, {R("sum(w * coalesce(h.z, 0.0))")} AS z, c.valid
FROM z c CROSS JOIN g LEFT JOIN z h ON h.modality = c.modality AND h.b = c.b - lag WHERE c.b % 3 = 0 GROUP BY ALL"""
)
def decimated_stream(spark, sf_dir):
    return rounded(wavelets.decimated(zgrid(spark, sf_dir), M, "z", 3), "z")


@query(
    f"""WITH {CH}, k AS (SELECT vec_id, CAST(channel // 16 AS INT) AS region, x, x > -0.1 AS ok FROM ch)
SELECT vec_id, region, {R("coalesce(avg(x) FILTER (ok), 0.0)")} AS x, count(*) FILTER (ok) >= 8 AS valid FROM k GROUP BY ALL"""
)
def region_signals(spark, sf_dir):
    v = streams.table(spark, sf_dir, "embeddings").withColumn("ok", F.transform("embedding", lambda x: x.cast("double") > -0.1))
    out = v.select("vec_id", F.posexplode(wavelets.regions(F.col("embedding"), F.col("ok"), [range(16 * i, 16 * i + 16) for i in range(4)])).alias("region", "s"))
    return out.select("vec_id", "region", r6("s.x").alias("x"), "s.valid")


@query(
    f"""WITH {ANALYTIC}, pr AS (SELECT a.b, a.re AS r1, a.im AS i1, c.re AS r2, c.im AS i2, greatest(sqrt((a.re * a.re + a.im * a.im) * (c.re * c.re + c.im * c.im)), 1e-30) AS s FROM an a JOIN an c ON a.b = c.b WHERE a.modality = 'click' AND c.modality = 'view')
SELECT b, {R("(r1 * r2 + i1 * i2) / s")} AS cos, {R("(i1 * r2 - r1 * i2) / s")} AS sin FROM pr"""
)
def interbrain_phase(spark, sf_dir):
    a = analytic(spark, sf_dir)
    one, two = (a.where(F.col("modality") == m).select("b", F.col("re").alias(f"r{i}"), F.col("im").alias(f"i{i}")) for i, m in ((1, "click"), (2, "view")))
    cos, sin = wavelets.phase_features(*(F.col(c) for c in ("r1", "i1", "r2", "i2")))
    return one.join(two, "b").select("b", r6(cos).alias("cos"), r6(sin).alias("sin"))


@query(
    f"""WITH {ANALYTIC}, {values("g", wavelets.gaussian(5.0 * 4.0 / 0.5 / 6))}, pr AS (SELECT a.b, a.re * a.re + a.im * a.im AS xx, c.re * c.re + c.im * c.im AS yy, a.re * c.re + a.im * c.im AS sr, a.re * c.im - a.im * c.re AS si FROM an a JOIN an c ON a.b = c.b WHERE a.modality = 'click' AND c.modality = 'view'),
sm AS (SELECT p.b, sum(w * coalesce(q.xx, 0.0)) AS xx, sum(w * coalesce(q.yy, 0.0)) AS yy, sum(w * coalesce(q.sr, 0.0)) AS sr, sum(w * coalesce(q.si, 0.0)) AS si FROM pr p CROSS JOIN g LEFT JOIN pr q ON q.b = p.b - lag GROUP BY ALL)
SELECT 'click' AS src, b, {R("sqrt((sr * sr + si * si) / greatest(xx * yy, 1e-20))")} AS coherence FROM sm"""
)
def wavelet_coherence(spark, sf_dir):
    z = zgrid(spark, sf_dir).where(F.col("modality").isin("click", "view")).groupBy("b").pivot("modality", ["click", "view"]).agg(F.max("z")).withColumn("src", F.lit("click"))
    return rounded(wavelets.canonical_coherence(z, ["src"], ["click"], ["view"], 4.0, (0.5,)), "coherence")


@query()
def canonical_coherence(spark, sf_dir):
    z = zgrid(spark, sf_dir).groupBy("b").pivot("modality", list(_MODS)).agg(F.max("z")).withColumn("src", F.lit("all"))
    return rounded(wavelets.canonical_coherence(z, ["src"], ["click", "error"], ["purchase", "view"], 4.0, (0.5,)), "coherence")


@query(
    f"""WITH {SHIFTED}, st AS (SELECT modality, avg(x_shifted) AS m, stddev_pop(x_shifted) AS s FROM su GROUP BY ALL), cut AS (SELECT modality, greatest(quantile_cont(top, 0.9), 1.0) AS cut FROM (SELECT modality, k, max(CASE WHEN s > 1e-12 THEN (x_shifted - m) / s ELSE 0 END) AS top FROM su JOIN st USING (modality) GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT z.modality, b, CASE WHEN s > 1e-12 THEN (z - m) / s ELSE 0 END - cut + 1.5 AS v, CASE WHEN s > 1e-12 THEN (z - m) / s ELSE 0 END AS q, cut FROM z JOIN st USING (modality) JOIN cut USING (modality)),
up AS (SELECT *, q > cut AS u FROM sc), r AS (SELECT *, b - row_number() OVER (PARTITION BY modality, u ORDER BY b) AS r FROM up), n AS (SELECT *, count(*) OVER (PARTITION BY modality, u, r) AS len FROM r)
SELECT modality, b, {R("q")} AS z, {R("1 / (1 + exp(-2 * (q - cut)))")} AS posterior, u AND len >= 2 AS masked FROM n"""
)
def coherence_mask(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    real = z.select("modality", "b", F.col("z").alias("v"))
    return rounded(wavelets.coherence_mask(real, shifted(z, spark).withColumnRenamed("x_shifted", "v"), M, "v"), "z", "posterior")


@query(
    f"""WITH {Z}, le AS (SELECT modality, count(*) AS l FROM z GROUP BY ALL), p AS (SELECT modality, b, z, b - (l - 1) / 2.0 AS u, (b - (l - 1) / 2.0) ** 2 - (l * l - 1) / 12.0 AS v FROM z JOIN le USING (modality)),
f AS (SELECT modality, avg(z) AS c0, sum(z * u) / sum(u * u) AS c1, sum(z * v) / sum(v * v) AS c2 FROM p GROUP BY ALL) SELECT modality, b, {R("z - c0 - c1 * u - c2 * v")} AS detrended FROM p JOIN f USING (modality)"""
)
def detrended_target(spark, sf_dir):
    return rounded(screening.detrended(zgrid(spark, sf_dir), M, "z").select("modality", "b", "detrended"), "detrended")


WHITE = Z + """, la AS (SELECT modality, b, z, coalesce(lag(z) OVER (PARTITION BY modality ORDER BY b), 0.0) AS ar1 FROM z), wf AS (SELECT modality, sum(ar1 * z) / (sum(ar1 * ar1) + 0.001) AS a FROM la GROUP BY ALL), rs AS (SELECT modality, b, ar1, z - a * ar1 AS residual FROM la JOIN wf USING (modality))"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.whitened(temporal.ar_terms(zgrid(spark, sf_dir), M, 1), M, "z", ["ar1"])


@query(f"WITH {WHITE} SELECT modality, b, {R('residual')} AS residual FROM rs")
def whitened_target(spark, sf_dir):
    return rounded(residuals(spark, sf_dir).select("modality", "b", "residual"), "residual")


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, b, x, residual): each stream one bin earlier with each other's whitened target."""
    r = residuals(spark, sf_dir)
    return r.select(F.col("modality").alias("src"), "b", F.col("ar1").alias("x")).join(r.select(F.col("modality").alias("tgt"), "b", "residual"), "b").where("src <> tgt")


@query(f"WITH {WHITE} SELECT a.modality AS src, c.modality AS tgt, {R('avg(a.ar1 * c.residual)')} AS cc, {R('avg(a.ar1 * c.residual) ** 2')} AS norm2 FROM rs a JOIN rs c ON a.b = c.b AND a.modality <> c.modality GROUP BY ALL")
def matched_cross_covariance(spark, sf_dir):
    out = screening.matched_cross(crossed(spark, sf_dir), ["src", "tgt"], ["x"], "residual")
    return out.select("src", "tgt", r6(F.col("cc")[0]).alias("cc"), r6("norm2").alias("norm2"))


@query(
    f"""WITH {SHIFTED}, d AS (SELECT c.modality AS tgt, a.modality AS src, -1 AS k, a.z AS x, c.z AS y FROM z a JOIN z c ON a.b = c.b AND a.modality <> c.modality UNION ALL SELECT c.modality, a.modality, a.k, a.x_shifted, c.z FROM su a JOIN z c ON a.b = c.b AND a.modality <> c.modality),
m AS (SELECT tgt, k, src, avg(x * y) AS cc, avg(x * x) AS g FROM d GROUP BY ALL), g AS (SELECT tgt, avg(g) AS g FROM m WHERE k = -1 GROUP BY ALL), s AS (SELECT m.tgt, k, src, cc * cc / greatest(g.g, 1e-8) AS s FROM m JOIN g ON g.tgt = m.tgt),
st AS (SELECT tgt, k, sum(s) AS total, max(s) AS largest FROM s GROUP BY ALL), l AS (SELECT tgt, k, unnest([0, 1, 2]) AS w, unnest([total, largest, largest]) AS v FROM st),
n AS (SELECT tgt, w, avg(v) AS m, stddev_pop(v) AS d FROM l WHERE k >= 0 GROUP BY ALL), t AS (SELECT l.tgt, k, max(CASE WHEN d > 1e-12 THEN (v - m) / d ELSE 0 END) AS top FROM l JOIN n ON n.tgt = l.tgt AND n.w = l.w GROUP BY ALL)
SELECT r.tgt, {R("any_value(st.total)")} AS total, {R("any_value(st.largest)")} AS largest, {R("any_value(st.largest)")} AS upper, {R("any_value(r.top)")} AS max_z, {R("(sum(CASE WHEN t.top >= r.top THEN 1 ELSE 0 END) + 1) / (count(*) + 1)")} AS p
FROM t JOIN t r ON r.tgt = t.tgt AND r.k = -1 JOIN st ON st.tgt = r.tgt AND st.k = -1 WHERE t.k >= 0 GROUP BY r.tgt"""
)
def matched_screen(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    moved = z.select("modality", F.lit(-1).alias("k"), "b", F.col("z").alias("x")).union(shifted(z, spark).select("modality", "k", "b", "x_shifted"))
    rows = moved.withColumnRenamed("modality", "src").join(z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y")), "b").where("src <> tgt")
    return rounded(screening.matched_screen(rows, ["tgt"], "src", ["x"], "y"), "total", "largest", "upper", "max_z", "p")


@query()
def svd_screen(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    moved = z.select("modality", F.lit(-1).alias("k"), "b", F.col("z").alias("x")).union(shifted(z, spark).select("modality", "k", "b", "x_shifted"))
    rows = moved.withColumnRenamed("modality", "src").join(z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y")), "b").where("src <> tgt")
    return screening.svd_screen(rows.groupBy("k", "src", "tgt").agg(F.avg(F.col("x") * F.col("y")).alias("c")).withColumn("pathway", F.lit("all")), ["pathway"], "src", "tgt", "c")


@query(
    f"""WITH {SHIFTED}, d AS (SELECT a.modality AS src, c.modality AS tgt, -1 AS k, a.z AS x, c.z AS y FROM z a JOIN z c ON a.b = c.b AND a.modality <> c.modality UNION ALL SELECT a.modality, c.modality, a.k, a.x_shifted, c.z FROM su a JOIN z c ON a.b = c.b AND a.modality <> c.modality),
cc AS (SELECT k, src, tgt, avg(x * y) AS c FROM d GROUP BY ALL), ca AS (SELECT src, row_number() OVER (ORDER BY src DESC) AS r FROM (SELECT src FROM cc WHERE k = -1 GROUP BY src ORDER BY round(sum(c * c), 9) DESC, src LIMIT 2)),
pr AS (SELECT k, tgt, coalesce(max(c) FILTER (r = 1), 0.0) AS u, coalesce(max(c) FILTER (r = 2), 0.0) AS v FROM cc JOIN ca USING (src) GROUP BY ALL), gr AS (SELECT k, sum(u * u) AS a, sum(u * v) AS b, sum(v * v) AS d FROM pr GROUP BY ALL),
sg AS (SELECT k, round(sqrt((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2), 9) AS sigma FROM gr)
SELECT 'all' AS pathway, {R("r.sigma")} AS sigma, count(*) AS n_null, {R("(sum((n.sigma >= r.sigma)::INT) + 1) / (count(*) + 1)")} AS p FROM sg r JOIN sg n ON n.k >= 0 WHERE r.k = -1 GROUP BY r.sigma"""
)
def targeted_svd(spark, sf_dir):
    """The two sources of the largest cross-covariances, all their targets together."""
    z = zgrid(spark, sf_dir)
    moved = z.select("modality", F.lit(-1).alias("k"), "b", F.col("z").alias("x")).union(shifted(z, spark).select("modality", "k", "b", "x_shifted"))
    rows = moved.withColumnRenamed("modality", "src").join(z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y")), "b").where("src <> tgt")
    cross = rows.groupBy("k", "src", "tgt").agg(F.avg(F.col("x") * F.col("y")).alias("c")).withColumn("pathway", F.lit("all"))
    best = cross.where("k = -1").groupBy("pathway", "src").agg(F.round(F.sum(F.col("c") * F.col("c")), 9).alias("s")).orderBy(F.desc("s"), "src").limit(2)
    return rounded(screening.targeted_svd(cross, best, ["pathway"], "src", "tgt", "c", rank=4), "sigma", "p")


FEATURES = Z + f""", bas(s, j, v) AS (VALUES {_VALUES}), c AS (SELECT g.modality, g.b, j, sum(v * coalesce(h.z, 0.0)) AS c FROM z g CROSS JOIN bas LEFT JOIN z h ON h.modality = g.modality AND h.b = g.b - s GROUP BY ALL),
cy AS (SELECT t.modality AS tgt, c.modality AS grp, c.j, avg(c.c * t.z) AS q FROM c JOIN z t ON t.b = c.b GROUP BY ALL)"""


@query(
    f"""WITH {FEATURES}, g AS (SELECT tgt, grp, round(sqrt(sum(q * q)), 9) AS gradient FROM cy GROUP BY ALL)
SELECT tgt, grp, {R("gradient")} AS gradient, CAST(row_number() OVER (PARTITION BY tgt ORDER BY gradient DESC, grp) AS INT) AS rank FROM g QUALIFY rank <= 5"""
)
def gradient_screen(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return rounded(screening.gradient_screen(rows, ["tgt"], columns, groups, "y"), "gradient")


@query(f"WITH {FEATURES}, g AS (SELECT tgt, grp, sqrt(sum(q * q)) AS s FROM cy GROUP BY ALL) SELECT tgt, {R('max(s)')} AS lam FROM g GROUP BY ALL")
def lambda_max(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return rounded(regression.lasso_path(regression.moments(rows, ["tgt"], [*columns, "y"]), ["tgt"], groups, 1).select("tgt", "lam"), "lam")


@query()
def lasso_path(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return regression.lasso_path(regression.moments(rows, ["tgt"], [*columns, "y"]), ["tgt"], groups)


@query()
def cross_validated_lambda(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return regression.cross_validated(rows, ["tgt"], columns, groups, "y", 4, 6)


@query()
def per_target_selection(spark, sf_dir):
    from lagweave.operators import selection

    rows, columns, groups = _wide(spark, sf_dir)
    found = selection.stability(rows, ["tgt"], columns, groups, "y", 0.05)
    return screening.over_targets(found, ["grp"], "tgt", "share", "stable")


@query()
def per_target_blocks(spark, sf_dir):
    """Groups that blocks of rows select for each target on its own, joined over targets."""
    from lagweave.operators import selection

    rows, columns, groups = _wide(spark, sf_dir)
    found = selection.blocks(rows, ["tgt"], columns, groups, "y", 0.1, 30).withColumns({"hit": F.col("p") < 0.2, "share": F.col("hits") / F.col("n_blocks")})
    return screening.over_targets(found, ["grp"], "tgt", "share", "hit")


TIMES = Z + """, l AS (SELECT modality, b, z, coalesce(lag(z, 1) OVER w, 0.0) AS a, coalesce(lag(z, 2) OVER w, 0.0) AS c FROM z WINDOW w AS (PARTITION BY modality ORDER BY b)),
wi AS (SELECT *, unnest(range(greatest(0, CAST(ceil((b - 15) / 8.0) AS INT)), b // 8 + 1)) AS w FROM l), co AS (SELECT modality, CAST(w AS INT) AS b, count(*) AS n, corr(z, a) AS r1, corr(z, c) AS r2, corr(a, c) AS q FROM wi GROUP BY ALL),
rr AS (SELECT modality, b, n, 0.0 AS r2_restricted, CASE WHEN n >= 8 AND q * q < 0.999 THEN (r1 * r1 + r2 * r2 - 2 * r1 * r2 * q) / (1 - q * q) END AS r2_full FROM co),
ft AS (SELECT *, (greatest(r2_full - r2_restricted, 0.0) / 2) / (greatest(1 - r2_full, 1e-10) / greatest(n - 2, 1)) AS f FROM rr), fp AS (SELECT *, CASE WHEN f IS NOT NULL AND NOT isnan(f) AND n - 2 > 1 THEN pow(1 + 2 * f / (n - 2), -(n - 2) / 2.0) ELSE 1.0 END AS p FROM ft)"""


def window_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(modality, b, n, r2_full, r2_restricted): how far the two values before explain each, by window of 16 rows."""
    rows = signals.windows(temporal.ar_terms(zgrid(spark, sf_dir), M, 2), 16, 8).groupBy("modality", F.col("w").alias("b"))
    co = rows.agg(F.count("*").alias("n"), F.corr("z", "ar1").alias("r1"), F.corr("z", "ar2").alias("r2"), F.corr("ar1", "ar2").alias("q"))
    full = (F.col("r1") * F.col("r1") + F.col("r2") * F.col("r2") - 2 * F.col("r1") * F.col("r2") * F.col("q")) / (1 - F.col("q") * F.col("q"))
    return co.select("modality", "b", "n", F.lit(0.0).alias("r2_restricted"), F.when((F.col("n") >= 8) & (F.col("q") * F.col("q") < 0.999), full).alias("r2_full"))


@query(f"WITH {TIMES} SELECT modality, b, n, {R('f')} AS f, {R('p')} AS p FROM fp")
def f_test_timecourse(spark, sf_dir):
    return rounded(stage2.f_test_timecourse(window_fits(spark, sf_dir), 2, 0).select("modality", "b", "n", "f", "p"), "f", "p")


@query(
    f"""WITH {TIMES}, o AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY p, b) AS r, count(*) OVER (PARTITION BY modality) AS m FROM fp),
j AS (SELECT *, least(min(p * m / r) OVER (PARTITION BY modality ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS a FROM o) SELECT modality, b, {R("p")} AS p, {R("a")} AS p_adjusted, a < 0.2 AS significant FROM j"""
)
def corrected_f_test(spark, sf_dir):
    out = stage2.corrected_f_test(window_fits(spark, sf_dir), ["b"], ["modality"], 2, 0, 0.2)
    return rounded(out.select("modality", "b", "p", "p_adjusted", "significant"), "p", "p_adjusted")


_G = 0.9
EWLS = PAIRS + f""", la AS (SELECT modality, b, coalesce(lag(z) OVER (PARTITION BY modality ORDER BY b), 0.0) AS o, valid FROM z), dd AS (SELECT pr.src, pr.tgt, pr.b, pr.x, la.o, pr.y, la.valid::INT AS v FROM pr JOIN la ON la.modality = pr.tgt AND la.b = pr.b WHERE pr.src <> pr.tgt),
ws AS (SELECT t.src, t.tgt, t.b, any_value(t.x) AS x, any_value(t.o) AS o, any_value(t.y) AS y, sum(w) AS n, sum(w * s.y) AS sy, sum(w * s.x * s.x) AS xx, sum(w * s.x * s.o) AS xo, sum(w * s.o * s.o) AS oo, sum(w * s.x * s.y) AS xy, sum(w * s.o * s.y) AS oy
FROM dd t JOIN (SELECT *, b AS sb FROM dd) s ON s.src = t.src AND s.tgt = t.tgt, LATERAL (SELECT s.v * CASE WHEN s.sb <= t.b THEN pow({_G}, t.b - s.sb) ELSE pow({_G}, s.sb - t.b - 1) END AS w) GROUP BY ALL),
so AS (SELECT *, (xx + 0.001) * (oo + 0.001) - xo * xo AS det, y - sy / greatest(n, 1e-12) AS dv FROM ws), be AS (SELECT *, ((oo + 0.001) * xy - xo * oy) / det AS b1, ((xx + 0.001) * oy - xo * xy) / det AS b2, oy / (oo + 0.001) AS b0 FROM so),
ew AS (SELECT src, tgt, b, CASE WHEN n >= 5 THEN CASE WHEN dv * dv > 1e-10 THEN least(greatest(1 - pow(y - b1 * x - b2 * o, 2) / (dv * dv), -1.0), 1.0) ELSE 0.0 END END AS r2_full, CASE WHEN n >= 5 THEN CASE WHEN dv * dv > 1e-10 THEN least(greatest(1 - pow(y - b0 * o, 2) / (dv * dv), -1.0), 1.0) ELSE 0.0 END END AS r2_restricted FROM be)"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided weighted fits of each stream on another's value before, and its own."""
    z = zgrid(spark, sf_dir)
    own = temporal.ar_terms(z, M, 1).select(F.col("modality").alias("tgt"), "b", F.col("ar1").alias("o")).join(z.select(F.col("modality").alias("tgt"), "b", "valid"), ["tgt", "b"])
    rows = pair_rows(spark, sf_dir).where("src <> tgt").join(own, ["tgt", "b"])
    return regression.ewls(rows, ["src", "tgt"], ["x"], ["o"], "y", _G, min_n=5, chunk=32)


@query(f"WITH {EWLS} SELECT src, tgt, b, {R('r2_full')} AS r2_full, {R('r2_restricted')} AS r2_restricted, {R('r2_full - r2_restricted')} AS dr2 FROM ew")
def ewls_pair(spark, sf_dir):
    out = weighted(spark, sf_dir)
    return out.select("src", "tgt", "b", *[r6(F.nanvl(c, F.lit(None))).alias(c) for c in ("r2_full", "r2_restricted", "dr2")])


@query(
    f"""WITH {EWLS}, sh AS (SELECT CAST(k AS INT) AS k, CAST(greatest(1, (SELECT max(b) + 1 FROM grid) // 10) + k * greatest(1, ((SELECT max(b) + 1 FROM grid) - 2 * greatest(1, (SELECT max(b) + 1 FROM grid) // 10)) // 8) AS INT) AS s FROM range(8) r(k)),
su AS (SELECT z.modality, sh.k, CAST((z.b + sh.s) % (SELECT max(b) + 1 FROM grid) AS INT) AS b, z.z AS x_shifted FROM z CROSS JOIN sh),
re AS (SELECT a.modality AS src, c.modality AS tgt, abs(avg(a.z * c.z)) AS stat FROM z a JOIN z c ON a.b = c.b AND a.modality <> c.modality GROUP BY ALL), nu AS (SELECT a.modality AS src, c.modality AS tgt, a.k, abs(avg(a.x_shifted * c.z)) AS stat FROM su a JOIN z c ON a.b = c.b AND a.modality <> c.modality GROUP BY ALL),
pv AS (SELECT src, tgt, (sum(CASE WHEN nu.stat >= re.stat THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p FROM nu JOIN re USING (src, tgt) GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY p, src, tgt) AS r, count(*) OVER () AS m FROM pv), j AS (SELECT *, least(min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS a FROM o),
su2 AS (SELECT src, tgt, avg(r2_full - r2_restricted) AS mean_dr2, avg(CASE WHEN coalesce(round(r2_full - r2_restricted, 9), 0.0) > 0.01 THEN 1.0 ELSE 0.0 END) AS fraction FROM ew GROUP BY ALL)
SELECT src, tgt, {R("mean_dr2")} AS mean_dr2, {R("fraction")} AS fraction, {R("a")} AS p_adjusted, a < 0.6 AND coalesce(mean_dr2, 0.0) >= -0.05 AND coalesce(fraction, 0.0) >= 0.03 AS significant FROM j JOIN su2 USING (src, tgt)"""
)
def stage2_decisions(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    y = z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y"))
    now = z.select(F.col("modality").alias("src"), "b", F.col("z").alias("x")).join(y, "b").where("src <> tgt")
    moved = shifted(z, spark).select(F.col("modality").alias("src"), "k", "b", F.col("x_shifted").alias("x")).join(y, "b").where("src <> tgt")
    screened = stage2.surrogate_screen(now, moved, ["src", "tgt"], "x", "y", 0.6)
    series = weighted(spark, sf_dir).withColumn("dr2", F.nanvl("dr2", F.lit(None)))
    series = series.withColumn("posterior", (F.coalesce(F.round("dr2", 9), F.lit(0.0)) > 0.01).cast("double"))
    return rounded(stage2.decisions(series, screened, ["src", "tgt"], -0.05), "mean_dr2", "fraction", "p_adjusted")


@query(f"WITH {SHIFTED}, f AS (SELECT modality, k, avg((x_shifted > 1)::INT) AS f FROM su GROUP BY ALL) SELECT modality, {R('quantile_cont(f, 0.9)')} AS threshold FROM f GROUP BY ALL")
def calibrated_threshold(spark, sf_dir):
    return rounded(stage2.calibrated_cut(shifted(zgrid(spark, sf_dir), spark), M, "x_shifted", 1.0), "threshold")


@query(f"WITH {FEATURES} SELECT grp AS src, tgt, CAST(s AS INT) AS lag, {R('sum(q * v)')} AS h FROM cy JOIN bas ON bas.j = cy.j WHERE grp <> tgt GROUP BY ALL")
def lag_kernel(spark, sf_dir):
    weights = design(spark, sf_dir).groupBy("src", "tgt").agg(F.array(*[F.avg(F.col(f"c{j}") * F.col("y")) for j in range(3)]).alias("w"))
    return rounded(stage2.kernel(weights, ["src", "tgt"], BASIS.tolist()), "h")


@query(
    f"""WITH {CH}, s AS (SELECT label, channel, avg(x) AS v FROM ch GROUP BY ALL), m AS (SELECT label, CAST(channel // 4 AS INT) AS freq, CAST(channel % 4 AS INT) AS region, sqrt(sum(v * v)) AS size FROM s GROUP BY ALL)
SELECT label, freq, region, {R("size")} AS size, {R("CASE WHEN freq >= 4 THEN size ELSE 0.0 END")} AS floored FROM m"""
)
def spectral_map(spark, sf_dir):
    each = discovery.elements(streams.table(spark, sf_dir, "embeddings").withColumn("id", F.col("label")), "label", "embedding").withColumnRenamed("id", "label")
    out = stage2.spectral_map(each.groupBy("label", "channel").agg(F.avg("x").alias("v")), ["label"], "channel", "v", 4).withColumn("floored", F.col("size"))
    return rounded(stage2.above_floor(out, "freq", 4, ["floored"]), "size", "floored")


@query(f"WITH {Z}, e AS (SELECT modality, min(b) AS a, max(b) AS q FROM z GROUP BY ALL) SELECT modality, b, {R('z')} AS z FROM z JOIN e USING (modality) WHERE b >= a + 5 AND b <= q - 5")
def trimmed_times(spark, sf_dir):
    return rounded(stage2.trimmed(zgrid(spark, sf_dir).select("modality", "b", "z"), M, 5), "z")


@query(
    f"""WITH {ACT}, m AS (SELECT b, x FROM act WHERE modality = 'click'), s AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM m)
SELECT a.modality, a.b, {R("a.z * coalesce(CASE WHEN d > 1e-8 THEN (m.x - s.m) / d ELSE 0.0 END, 0.0)")} AS moderated FROM act a LEFT JOIN m USING (b), s"""
)
def moderated_source(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    heart = z.where("modality = 'click'").select(F.lit(1).alias("one"), "b", "x")
    out = stage2.moderators(z.withColumn("one", F.lit(1)), heart, ["one"], "x")
    return out.select("modality", "b", r6(F.col("z") * F.coalesce("moderator", F.lit(0.0))).alias("moderated"))


PEOPLE = EV + """, pb AS (SELECT participant, modality, CAST(floor(t / 21600) AS INT) AS b, avg(x) AS x FROM ev GROUP BY ALL),
dp AS (SELECT CASE WHEN s.participant = 'p1' THEN 'p1-p2' ELSE 'p2-p1' END AS direction, s.modality AS src, t.modality AS tgt, s.b, s.x, t.x AS y FROM pb s JOIN pb t ON s.b = t.b AND s.participant <> t.participant)"""


def directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(direction, src, tgt, b, x, y): one person's streams beside the other's, both ways."""
    bins = streams.samples(spark, sf_dir).groupBy("participant", "modality", F.floor(F.col("t") / streams.BIN_S).cast("int").alias("b")).agg(F.avg("x").alias("x"))
    src, tgt = pairs.both_directions(bins, "participant", "p1", "p2")
    return src.withColumnsRenamed({"modality": "src"}).join(tgt.withColumnsRenamed({"modality": "tgt", "x": "y"}), ["direction", "b"])


@query(f"WITH {PEOPLE} SELECT direction, src, tgt, count(*) AS n, {R('corr(x, y)')} AS r FROM dp GROUP BY ALL")
def both_directions(spark, sf_dir):
    return rounded(directed(spark, sf_dir).groupBy("direction", "src", "tgt").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")), "r")


@query(
    f"""WITH {PEOPLE}, d AS (SELECT direction, src, tgt, round(corr(x, y), 9) > 0 AS significant FROM dp GROUP BY ALL HAVING count(*) >= 10)
SELECT direction, b, round(avg(x * y), 3) + 0.0 AS mean FROM dp JOIN d USING (direction, src, tgt) WHERE significant GROUP BY ALL"""
)
def average_significant(spark, sf_dir):
    rows = directed(spark, sf_dir)
    keys = ["direction", "src", "tgt"]
    chosen = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.round(F.corr("x", "y"), 9) > 0).alias("significant")).where("n >= 10")
    out = pairs.average_significant(rows.withColumn("v", F.col("x") * F.col("y")), chosen, keys, "v")
    return out.withColumn("mean", F.round("mean", 3) + F.lit(0.0))


@query(
    f"""WITH {ASOF.replace("unnest(range(0, (SELECT CAST(max(t) AS BIGINT) + 10800 FROM ev), 10800))::DOUBLE AS t FROM (SELECT DISTINCT modality FROM ev)", "CAST(floor(t / 21600) AS INT) * 21600.0 AS t FROM (SELECT DISTINCT modality, CAST(floor(t / 21600) AS INT) * 21600.0 AS t FROM ev)")}, co AS (SELECT modality, CAST(floor(t / 21600) AS INT) * 21600.0 AS t, avg(x) AS x FROM ev GROUP BY ALL)
SELECT co.modality, co.t, {R("co.x")} AS x, {R("coalesce(x0 + CASE WHEN t1 > t0 THEN (f.t - t0) / (t1 - t0) ELSE 0 END * (x1 - x0), x0, x1)")} AS fine FROM co JOIN f ON f.modality = co.modality AND f.t = co.t"""
)
def on_coarser_grid(spark, sf_dir):
    s = streams.samples(spark, sf_dir)
    coarse = s.groupBy("modality", (F.floor(F.col("t") / streams.BIN_S) * F.lit(float(streams.BIN_S))).alias("t")).agg(F.avg("x").alias("x"))
    return rounded(pairs.on_coarser(s, coarse, M, "x"), "x", "fine")


CROSS = """se AS (SELECT DISTINCT user_id FROM events), pl AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id::VARCHAR)) - 1 AS place, count(*) OVER () AS n FROM se),
cp AS (SELECT p.user_id AS a, q.user_id AS b FROM pl p JOIN pl q ON q.place = (p.place + 1) % p.n WHERE p.user_id <> q.user_id)"""


@query(f"WITH {CROSS} SELECT a, b FROM cp")
def cross_pairs(spark, sf_dir):
    return pairs.cross_pairs(streams.table(spark, sf_dir, "events").select("user_id"), "user_id")


@query(
    f"""WITH {EV}, {CROSS}, s0 AS (SELECT user_id, min(t) AS t0 FROM ev GROUP BY ALL), bi AS (SELECT DISTINCT user_id, CASE WHEN event_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS person, CAST(floor((t - t0) / 172800) AS INT) AS k FROM ev JOIN s0 USING (user_id)),
bo AS (SELECT a, cp.b, x.k FROM cp JOIN bi x ON x.user_id = a AND x.person = 'p1' JOIN bi y ON y.user_id = cp.b AND y.person = 'p2' AND y.k = x.k), ru AS (SELECT *, k - row_number() OVER (PARTITION BY a, b ORDER BY k) AS r FROM bo),
le AS (SELECT a, b, CAST(min(k) AS INT) AS start, count(*) AS length FROM ru GROUP BY a, b, r HAVING count(*) >= 2) SELECT a, b, start, length FROM le QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY length DESC, start) = 1"""
)
def valid_cross_pairs(spark, sf_dir):
    """Pairs of users whose events share two days of their own time, twice in a row."""
    e = streams.samples(spark, sf_dir)
    begun = e.groupBy("user_id").agg(F.min("t").alias("t0"))
    rows = e.join(begun, "user_id").select("user_id", F.when(F.col("event_id") % 2 == 0, "p1").otherwise("p2").alias("person"), F.floor((F.col("t") - F.col("t0")) / 172800).cast("int").alias("b"), F.lit(True).alias("valid"))
    return pairs.valid_pairs(pairs.cross_pairs(e, "user_id"), rows, "user_id", "person", "p1", "p2", 2)


@query(
    f"""WITH {EV}, {CROSS}, s0 AS (SELECT user_id, min(t) AS t0 FROM ev GROUP BY ALL), sm AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS person, t - t0 AS t, x FROM ev JOIN s0 USING (user_id)),
ps AS (SELECT a || '+' || b AS pair, person, t, x FROM cp JOIN sm ON sm.user_id = a WHERE person = 'p1' UNION ALL SELECT a || '+' || b, person, t, x FROM cp JOIN sm ON sm.user_id = b WHERE person = 'p2')
SELECT pair, person, count(*) AS n, {R("max(t)")} AS last, {R("sum(x)")} AS total FROM ps GROUP BY ALL"""
)
def pseudo_sessions(spark, sf_dir):
    s = streams.samples(spark, sf_dir).withColumn("person", F.when(F.col("event_id") % 2 == 0, "p1").otherwise("p2"))
    out = pairs.pseudo_sessions(s, pairs.cross_pairs(s, "user_id"), "user_id", "person", "p1", "p2")
    return rounded(out.groupBy("pair", "person").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum("x").alias("total")), "last", "total")


SETS = """co AS (SELECT l_partkey AS feature, c_mktsegment AS pathway FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 10),
fs AS (SELECT pathway, count(*) AS n, list(feature ORDER BY feature) AS features FROM co GROUP BY ALL)"""


@query(f"WITH {SETS} SELECT pathway, n, pathway || ': ' || n || ' features (' || array_to_string(features[1:5], ', ') || CASE WHEN n > 5 THEN ', ...' ELSE '' END || ')' AS line FROM fs")
def discovery_summary(spark, sf_dir):
    o, c = streams.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), streams.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = streams.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    found = discovery.consistency(rows.select(F.col("l_partkey").alias("feature"), F.col("c_mktsegment").alias("pathway"), "c_custkey"), ["feature", "pathway"], "c_custkey", 10)
    sets = pairs.feature_sets(found)
    return sets.select("pathway", "n").join(pairs.summary_lines(sets), "pathway")


def _hex(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 6))::INT"


@query(
    f"""WITH {Z}, n AS (SELECT modality, count(*) AS n FROM z GROUP BY ALL), bl AS (SELECT modality, n, CAST(unnest(range(n // 5 + 1)) AS INT) AS blk FROM n), sz AS (SELECT *, 5 + {_hex("'7:' || modality || ':' || blk")} % 6 AS size FROM bl),
st AS (SELECT *, sum(size) OVER (PARTITION BY modality ORDER BY blk) - size AS start FROM sz), ok AS (SELECT *, least(size, n - start) AS len FROM st WHERE start < n), od AS (SELECT *, sum(len) OVER (PARTITION BY modality ORDER BY {_hex("'8:' || modality || ':' || blk")}, blk) - len AS dest FROM ok)
SELECT z.modality, CAST(dest + z.b - start AS INT) AS b, {R("z.z")} AS x_shuffled FROM z JOIN od ON od.modality = z.modality AND z.b >= start AND z.b < start + len"""
)
def ibi_shuffle(spark, sf_dir):
    return rounded(surrogates.ragged_shuffle(zgrid(spark, sf_dir), "modality", "z", (5, 10), 7), "x_shuffled")


_DFT = {k: f"pow(sum(z * cos(2 * pi() * {k} * (b - 8 * w) / 32)), 2) + pow(sum(z * sin(2 * pi() * {k} * (b - 8 * w) / 32)), 2)" for k in range(1, 13)}
_SUM = lambda ks: " + ".join(f"p{k}" for k in ks)


@query(
    f"""WITH {Z}, w AS (SELECT modality, b, z, CAST(unnest(range(greatest(0, CAST(ceil((b - 31) / 8.0) AS INT)), b // 8 + 1)) AS INT) AS w FROM z), f AS (SELECT modality, w, {", ".join(f"{v} AS p{k}" for k, v in _DFT.items())} FROM w GROUP BY ALL HAVING count(*) = 32)
SELECT modality, w, {R(f"({_SUM(range(7, 13))}) / ({_SUM(range(1, 7))} + 1e-20)")} AS engagement FROM f"""
)
def engagement_index(spark, sf_dir):
    return rounded(signals.engagement(zgrid(spark, sf_dir), M, "z", 32, 8, (1, 3), (4, 6), (7, 12)), "engagement")


@query(
    f"""WITH {ANALYTIC}, w AS (SELECT *, CAST(unnest(range(greatest(0, CAST(ceil((b - 11) / 4.0) AS INT)), b // 4 + 1)) AS INT) AS w FROM an), a AS (SELECT modality, w, atan2(avg(im / greatest(sqrt(re * re + im * im), 1e-30)), avg(re / greatest(sqrt(re * re + im * im), 1e-30))) AS phase, avg((re * re + im * im > 0.05 * -2 * ln(0.05))::INT) AS burst FROM w GROUP BY ALL)
SELECT modality, w, {R("cos(phase)")} AS cos, {R("sin(phase)")} AS sin, {R("burst")} AS burst FROM a"""
)
def phase_and_bursts(spark, sf_dir):
    return rounded(signals.phase_and_bursts(analytic(spark, sf_dir), M, "re", "im", 12, 4, 0.05), "cos", "sin", "burst")


@query(
    f"""WITH {CH}, l AS (SELECT vec_id, channel % 3 AS axis, avg(x) AS c, max(x) - min(x) AS e FROM ch WHERE channel < 63 GROUP BY ALL)
SELECT vec_id, {R("max(c) FILTER (axis = 0)")} AS cx, {R("max(c) FILTER (axis = 1)")} AS cy, {R("max(c) FILTER (axis = 2)")} AS cz, {R("sqrt(sum(e * e))")} AS extent FROM l GROUP BY ALL"""
)
def pose_geometry(spark, sf_dir):
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice(F.transform("embedding", lambda x: x.cast("double")), i * 3 + 1, 3))
    v = streams.table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points"))
    c = signals.centroid(F.col("points"), 3)
    return v.select("vec_id", r6(c[0]).alias("cx"), r6(c[1]).alias("cy"), r6(c[2]).alias("cz"), r6(signals.extent(F.col("points"), 3)).alias("extent"))


@query(
    f"""WITH {SHIFTED}, pp AS (SELECT a.k AS dr, a.b, a.x_shifted AS x, c.z AS y FROM su a JOIN z c ON a.b = c.b WHERE a.modality = 'click' AND c.modality = 'view'){_fourier("dr", "pp", {"x": "x", "y": "y"})}, c AS (SELECT dr, w, k, avg(xr * yr + xi * yi) AS cr, avg(xr * yi - xi * yr) AS ci, greatest(avg(xr * xr + xi * xi) * avg(yr * yr + yi * yi), 1e-20) AS p FROM ft GROUP BY ALL)
SELECT dr AS k, w, {R("avg((cr * cr + ci * ci) / p) FILTER (k <= 2)")} AS slow_msc, {R("avg(abs(ci) / sqrt(p)) FILTER (k <= 2)")} AS slow_imcoh, {R("avg((cr * cr + ci * ci) / p) FILTER (k >= 2)")} AS fast_msc, {R("avg(abs(ci) / sqrt(p)) FILTER (k >= 2)")} AS fast_imcoh FROM c GROUP BY ALL"""
)
def coherence_surrogates(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    moved = shifted(z.where("modality = 'click'"), spark).select("k", "b", F.col("x_shifted").alias("x"))
    rows = moved.join(z.where("modality = 'view'").select("b", F.col("z").alias("y")), "b")
    return rounded(signals.band_coherence(rows, ["k"], "x", "y", 32, 8, 4.0, {"slow": (0.0, 0.5), "fast": (0.5, 2.0)}), "slow_msc", "slow_imcoh", "fast_msc", "fast_imcoh")


@query(
    f"""WITH {EV}, bi AS (SELECT modality, CAST(floor(t / 21600) AS INT) AS b, avg(x) AS x, count(*) AS n FROM ev GROUP BY ALL)
SELECT modality, b, {R("x")} AS x, n FROM bi WHERE (b + 1) * 21600 <= (SELECT floor((max(t) - 3600) * 1000) / 1000 FROM ev)"""
)
def stream_grid(spark, sf_dir):
    out = causal.replayed(spark, f"{sf_dir}/events.parquet", lambda rows: causal.grid_bins(rows, "6 hours", "1 hour"))
    at = (F.unix_seconds("start") - F.unix_seconds(F.lit(streams.EPOCH).cast("timestamp"))) / streams.BIN_S
    return out.select("modality", at.cast("int").alias("b"), r6("x").alias("x"), "n")
