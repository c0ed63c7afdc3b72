"""Queries over the driver tables, each with the same result in DuckDB SQL.

The event stream gives the samples (see sources.streams), 6-hour bins the evaluation grid. Floats
are rounded to six places after all arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.functions.basis import raised_cosine
from lagweave.operators import analysis, conditions, discovery, episodes, localize, metrics, regression, selection, signals, spectra, states, switching, surrogates, temporal, wavelets
from lagweave.sources import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
M = ["modality"]
SHIFTS = 8

EV = """ev AS (SELECT event_id, user_id, event_type AS modality, CASE WHEN user_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS participant,
  date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t, value AS x FROM events)"""
GRID = (
    EV
    + """, binned AS (SELECT modality, CAST(floor(t / 21600) AS INT) AS b, avg(x) AS x, count(x) AS n FROM ev GROUP BY ALL),
steps AS (SELECT modality, CAST(unnest(generate_series(0, (SELECT max(b) FROM binned))) AS INT) AS b FROM (SELECT DISTINCT modality FROM binned)),
grid AS (SELECT s.modality, s.b, g.x, coalesce(g.n, 0) AS n, coalesce(g.n, 0) > 0 AS valid FROM steps s LEFT JOIN binned g ON g.modality = s.modality AND g.b = s.b)"""
)
Z = (
    GRID
    + """, stats AS (SELECT modality, avg(x) AS m, stddev_pop(x) AS s FROM grid WHERE valid GROUP BY modality),
z AS (SELECT g.*, CASE WHEN valid AND s > 1e-8 THEN least(greatest((x - m) / s, -10.0), 10.0) ELSE 0.0 END AS z FROM grid g LEFT JOIN stats USING (modality))"""
)
ACT = Z + """, act AS (SELECT *, avg(abs(z)) OVER (PARTITION BY modality ORDER BY b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS activity FROM z)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with SQL for the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.grid(streams.samples(spark, sf_dir), M, streams.BIN_S)


def zgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.zscore_clip(grid(spark, sf_dir), M)


def agrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.activity(zgrid(spark, sf_dir), M, 4)


def R(expr: str) -> str:  # noqa: N802
    return f"round({expr}, 6) + 0.0"


@query(f"WITH {EV} SELECT modality, participant, count(*) AS n, {R('max(t) - min(t)')} AS duration, {R('count(*) / (max(t) - min(t))')} AS rate FROM ev GROUP BY ALL")
def stream_summary(spark, sf_dir):
    return rounded(temporal.stream_summary(streams.samples(spark, sf_dir), ["modality", "participant"]), "duration", "rate")


@query(
    f"""WITH {EV}, sp AS (SELECT user_id, modality, min(t) AS a, max(t) AS b FROM ev GROUP BY ALL), sh AS (SELECT user_id, max(a) AS s, min(b) AS e FROM sp GROUP BY ALL HAVING max(a) < min(b))
SELECT event_id, user_id, modality, {R("t - s")} AS t FROM ev JOIN sh USING (user_id) WHERE t BETWEEN s AND e"""
)
def align_overlap(spark, sf_dir):
    out = temporal.align_overlap(streams.samples(spark, sf_dir), "user_id", "modality")
    return out.select("event_id", "user_id", "modality", r6("t").alias("t"))


@query(f"WITH {GRID} SELECT modality, b, {R('x')} AS x, n, valid FROM grid")
def grid_bins(spark, sf_dir):
    return rounded(grid(spark, sf_dir), "x")


@query(
    f"""WITH {EV}, k AS (SELECT modality, CAST(floor(t / 86400) AS INT) AS b, avg(CASE WHEN x > 10 THEN 1.0 ELSE 0.0 END) AS frac FROM ev GROUP BY ALL)
SELECT s.modality, s.b, {R("coalesce(frac, 0.0)")} AS frac FROM (SELECT DISTINCT modality, CAST(unnest(range((SELECT CAST(floor(max(t) / 86400) AS INT) + 1 FROM ev))) AS INT) AS b FROM ev) s LEFT JOIN k ON k.modality = s.modality AND k.b = s.b"""
)
def bin_validity(spark, sf_dir):
    rows = streams.samples(spark, sf_dir).withColumn("valid", F.col("x") > 10)
    return rounded(temporal.bin_validity(rows, M, None, 86400.0), "frac")


@query(f"WITH {Z} SELECT modality, b, {R('z')} AS z FROM z")
def zscore_clip(spark, sf_dir):
    return rounded(zgrid(spark, sf_dir).select("modality", "b", "z"), "z")


@query(f"WITH {ACT} SELECT modality, b, {R('activity')} AS activity FROM act")
def activity_channel(spark, sf_dir):
    return rounded(agrid(spark, sf_dir).select("modality", "b", "activity"), "activity")


@query(f"WITH {Z} SELECT modality, b, {R('coalesce(z - lag(z) OVER (PARTITION BY modality ORDER BY b), 0.0)')} AS dx FROM z")
def derivative(spark, sf_dir):
    return rounded(temporal.derivative(zgrid(spark, sf_dir), M, "z").select("modality", "b", "dx"), "dx")


GAPS = (
    GRID
    + """, holes AS (SELECT modality, b, x, n % 7 <> 0 AND valid AS valid FROM grid),
w AS (SELECT *, max(CASE WHEN valid THEN b END) OVER (PARTITION BY modality ORDER BY b ROWS UNBOUNDED PRECEDING) AS p, min(CASE WHEN valid THEN b END) OVER (PARTITION BY modality ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS q FROM holes)"""
)


@query(
    f"""WITH {GAPS} SELECT w.modality, w.b, {R("CASE WHEN w.valid THEN w.x WHEN q - p - 1 <= 2 THEN hp.x + (w.b - p) / (q - p) * (hq.x - hp.x) END")} AS filled
FROM w LEFT JOIN holes hp ON hp.modality = w.modality AND hp.b = p LEFT JOIN holes hq ON hq.modality = w.modality AND hq.b = q"""
)
def gap_fill_short(spark, sf_dir):
    holes = grid(spark, sf_dir).withColumn("valid", (F.col("n") % 7 != 0) & F.col("valid"))
    return rounded(temporal.fill_short_gaps(holes, M, 2).select("modality", "b", "filled"), "filled")


ASOF = (
    EV
    + """, src AS (SELECT modality, t, max(x) AS x FROM ev GROUP BY ALL), q AS (SELECT modality, unnest(range(0, (SELECT CAST(max(t) AS BIGINT) + 10800 FROM ev), 10800))::DOUBLE AS t FROM (SELECT DISTINCT modality FROM ev)),
a AS (SELECT q.modality, q.t, p.t AS t0, p.x AS x0 FROM q ASOF LEFT JOIN src p ON p.modality = q.modality AND q.t >= p.t),
f AS (SELECT a.*, n.t AS t1, n.x AS x1 FROM a ASOF LEFT JOIN src n ON n.modality = a.modality AND a.t <= n.t)"""
)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.samples(spark, sf_dir)
    last = s.agg(F.max("t").cast("long").alias("last"))
    times = s.select("modality").distinct().crossJoin(F.broadcast(last)).select("modality", F.explode(F.expr("cast(sequence(0l, last + 10799, 10800l) as array<double>)")).alias("t"))
    return temporal.asof(times, s, M)


@query(f"WITH {ASOF} SELECT modality, t, {R('coalesce(x1, x0)')} AS x FROM f")
def asof_next(spark, sf_dir):
    return rounded(temporal.asof_next(found(spark, sf_dir)).select("modality", "t", "x"), "x")


@query(
    f"""WITH {ASOF} SELECT modality, t, {R("least(coalesce(t - t0, 1e18), coalesce(t1 - t, 1e18))")} AS gap,
{R("CASE WHEN least(coalesce(t - t0, 1e18), coalesce(t1 - t, 1e18)) < 900 THEN CASE WHEN coalesce(t1 - t, 1e18) <= coalesce(t - t0, 1e18) THEN x1 ELSE x0 END END")} AS x FROM f"""
)
def asof_nearest(spark, sf_dir):
    return rounded(temporal.asof_nearest(found(spark, sf_dir), 900.0).select("modality", "t", "gap", "x"), "gap", "x")


@query(f"WITH {ASOF} SELECT modality, t, {R('coalesce(x0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END * (x1 - x0), x0, x1)')} AS x FROM f")
def asof_lerp(spark, sf_dir):
    return rounded(temporal.asof_lerp(found(spark, sf_dir)).select("modality", "t", "x"), "x")


BASIS, _LAGS = raised_cosine(3, 6.0, 0.0, 1.0, log=True)
_VALUES = ", ".join(f"({s}, {j}, {float(BASIS[s, j])!r}::DOUBLE)" for s in range(len(BASIS)) for j in range(3))


@query(
    f"""WITH {Z}, bas(s, j, v) AS (VALUES {_VALUES}), c AS (SELECT g.modality, g.b, j, sum(v * coalesce(h.z, 0.0)) AS c FROM z g CROSS JOIN bas LEFT JOIN z h ON h.modality = g.modality AND h.b = g.b - s GROUP BY ALL)
SELECT modality, b, {R("max(c) FILTER (j = 0)")} AS c0, {R("max(c) FILTER (j = 1)")} AS c1, {R("max(c) FILTER (j = 2)")} AS c2 FROM c GROUP BY ALL"""
)
def lag_convolution(spark, sf_dir):
    return rounded(temporal.lag_convolution(zgrid(spark, sf_dir), M, BASIS.tolist()), "c0", "c1", "c2")


@query(f"WITH {Z} SELECT modality, b, {R('z')} AS z, " + ", ".join(f"{R(f'coalesce(lag(z, {k}) OVER (PARTITION BY modality ORDER BY b), 0.0)')} AS ar{k}" for k in (1, 2, 3)) + " FROM z")
def ar_design(spark, sf_dir):
    return rounded(temporal.ar_terms(zgrid(spark, sf_dir), M, 3), "z", "ar1", "ar2", "ar3")


RULES = (("click", "error", "fast"), ("*", "signup", "medium"), ("purchase", "*", "mimicry"))


def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.samples(spark, sf_dir).select("modality").distinct()


@query("WITH m AS (SELECT DISTINCT event_type AS e FROM events) SELECT a.e AS src, b.e AS tgt, a.e = b.e AS same FROM m a, m b WHERE a.e <> 'signup' AND b.e <> 'view'")
def pathway_pairs(spark, sf_dir):
    return discovery.pathways(_dim(spark, sf_dir), ["signup"], ["view"]).withColumn("same", F.col("src") == F.col("tgt"))


@query(
    """WITH m AS (SELECT DISTINCT event_type AS e FROM events) SELECT a.e AS src, b.e AS tgt, CASE WHEN b.e = 'purchase' THEN 'slow' WHEN a.e = 'click' AND b.e = 'error' THEN 'fast'
WHEN b.e = 'signup' THEN 'medium' WHEN a.e = 'purchase' THEN 'mimicry' ELSE 'fast' END AS category FROM m a, m b"""
)
def pathway_category(spark, sf_dir):
    return discovery.pathways(_dim(spark, sf_dir)).withColumn("category", discovery.pathway_category(F.col("src"), F.col("tgt"), RULES, "purchase", "fast"))


CH = "ch AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INT) AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(
    f"""WITH {CH}, r AS (SELECT b.channel, corr(a.x, b.x) AS rho FROM ch a JOIN ch b ON a.vec_id = b.vec_id AND b.channel = a.channel + 1 GROUP BY ALL),
e AS (SELECT CAST(c.channel AS INT) AS channel, rho FROM range(64) c(channel) LEFT JOIN r ON r.channel = c.channel)
SELECT channel, {R("rho")} AS rho, sum(CASE WHEN abs(rho) > 0.05 THEN 0 ELSE 1 END) OVER (ORDER BY channel) - 1 AS grp FROM e"""
)
def adjacent_corr_groups(spark, sf_dir):
    return rounded(discovery.adjacent_groups(streams.table(spark, sf_dir, "embeddings"), "embedding", 64, 0.05), "rho")


@query(f"WITH {CH} SELECT vec_id, {R('sqrt(sum(x * x) / 64)')} AS rms FROM ch GROUP BY ALL")
def embedding_rms_norm(spark, sf_dir):
    return rounded(discovery.rms(streams.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "rms")


@query(
    f"""WITH {CH}, s AS (SELECT channel, round(abs(sum(x * label) - sum(x) * avg(label)) / count(*), 9) AS score FROM ch GROUP BY ALL)
SELECT channel, {R("score")} AS score, CAST(row_number() OVER (ORDER BY score DESC, channel) AS INT) AS rank FROM s QUALIFY rank <= 12"""
)
def sis_topk(spark, sf_dir):
    return rounded(discovery.sis_topk(streams.table(spark, sf_dir, "embeddings"), "embedding", "label", 64, 12), "score")


PAIRS = Z + """, pr AS (SELECT a.modality AS src, c.modality AS tgt, a.b, a.z AS x, c.z AS y FROM (SELECT modality, b, coalesce(lag(z) OVER (PARTITION BY modality ORDER BY b), 0.0) AS z FROM z) a JOIN z c ON a.b = c.b)"""


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, b, x, y): each stream one bin earlier against each stream, joined on the bin."""
    z = zgrid(spark, sf_dir)
    src = temporal.ar_terms(z, M, 1).select(F.col("modality").alias("src"), "b", F.col("ar1").alias("x"))
    return src.join(z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y")), "b")


RIDGE = """SELECT src, tgt, n, beta, CASE WHEN v * n > 1e-10 THEN least(greatest(1 - (yy - 2 * beta * xy + beta * beta * xx) / (v * n), -1.0), 1.0) ELSE 0.0 END AS r2
FROM (SELECT src, tgt, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, var_pop(y) AS v, sum(x * y) / (sum(x * x) + 0.001) AS beta FROM pr GROUP BY ALL)"""


@query(f"WITH {PAIRS}, rd AS ({RIDGE}) SELECT src, tgt, n, {R('beta')} AS beta, {R('r2')} AS r2 FROM rd")
def ridge_dr2_1d(spark, sf_dir):
    return rounded(regression.ridge_1d(pair_rows(spark, sf_dir), ["src", "tgt"], "x", "y", 1e-3), "beta", "r2")


@query(
    f"""SELECT l_returnflag, {R("regr_slope(ln(l_extendedprice), ln(l_quantity))")} AS slope, {R("regr_intercept(ln(l_extendedprice), ln(l_quantity))")} AS intercept,
{R("regr_r2(ln(l_extendedprice), ln(l_quantity))")} AS r2 FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY ALL"""
)
def aperiodic_fit(spark, sf_dir):
    return rounded(regression.log_slope(streams.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "slope", "intercept", "r2")


_N = "(SELECT max(b) + 1 FROM grid)"
SHIFTED = (
    Z
    + f""", sh AS (SELECT CAST(k AS INT) AS k, CAST(greatest(1, {_N} // 10) + k * greatest(1, ({_N} - 2 * greatest(1, {_N} // 10)) // {SHIFTS}) AS INT) AS s FROM range({SHIFTS}) r(k)),
su AS (SELECT z.modality, sh.k, CAST((z.b + sh.s) % {_N} AS INT) AS b, z.z AS x_shifted FROM z CROSS JOIN sh)"""
)


def shifted(z: DataFrame, spark: SparkSession) -> DataFrame:
    n = z.agg(F.max("b")).first()[0] + 1  # the length of the grid
    return surrogates.circular_shifts(z.select("modality", "b", F.col("z").alias("x")), M, n, SHIFTS)


@query(f"WITH {SHIFTED} SELECT modality, k, b, {R('x_shifted')} AS x_shifted FROM su")
def circular_shift_surrogates(spark, sf_dir):
    return rounded(shifted(zgrid(spark, sf_dir), spark), "x_shifted")


STAT = (
    SHIFTED
    + """, re AS (SELECT a.modality AS src, c.modality AS tgt, abs(avg(a.z * c.z)) AS stat FROM z a JOIN z c ON a.b = c.b AND a.modality <> c.modality GROUP BY ALL),
nu AS (SELECT a.modality AS src, c.modality AS tgt, a.k, abs(avg(a.x_shifted * c.z)) AS stat FROM su a JOIN z c ON a.b = c.b AND a.modality <> c.modality GROUP BY ALL),
pv AS (SELECT src, tgt, re.stat, count(*) AS n_null, (sum(CASE WHEN nu.stat >= re.stat THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p FROM nu JOIN re USING (src, tgt) GROUP BY ALL)"""
)


def real_and_null(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(src, tgt, stat) and (src, tgt, k, stat): size of the mean product of two streams, real and shifted."""
    z = zgrid(spark, sf_dir)
    tgt = z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y"))
    real = z.select(F.col("modality").alias("src"), "b", "z").join(tgt, "b").where("src <> tgt").groupBy("src", "tgt").agg(F.abs(F.avg(F.col("z") * F.col("y"))).alias("stat"))
    null = shifted(z, spark).withColumnRenamed("modality", "src").join(tgt, "b").where("src <> tgt").groupBy("src", "tgt", "k").agg(F.abs(F.avg(F.col("x_shifted") * F.col("y"))).alias("stat"))
    return real, null


@query(f"WITH {STAT} SELECT src, tgt, {R('stat')} AS stat, n_null, {R('p')} AS p FROM pv")
def empirical_pvalue(spark, sf_dir):
    return rounded(surrogates.empirical_p(*real_and_null(spark, sf_dir), ["src", "tgt"]), "stat", "p")


@query(
    f"""WITH {STAT}, o AS (SELECT *, row_number() OVER (ORDER BY p, src, tgt) AS r, count(*) OVER () AS m FROM pv),
j AS (SELECT *, least(min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS a FROM o) SELECT src, tgt, {R("p")} AS p, {R("a")} AS p_adjusted, a < 0.25 AS significant FROM j"""
)
def bh_fdr(spark, sf_dir):
    tests = surrogates.empirical_p(*real_and_null(spark, sf_dir), ["src", "tgt"]).select("src", "tgt", "p")
    return rounded(surrogates.bh_fdr(tests, ["src", "tgt"], alpha=0.25), "p", "p_adjusted")


ZED = (
    STAT
    + """, st AS (SELECT src, tgt, avg(stat) AS m, stddev_pop(stat) AS s FROM nu GROUP BY ALL), rz AS (SELECT src, tgt, CASE WHEN s > 1e-12 THEN (stat - m) / s ELSE 0 END AS z FROM re JOIN st USING (src, tgt)),
nz AS (SELECT src, tgt, k, CASE WHEN s > 1e-12 THEN (stat - m) / s ELSE 0 END AS z FROM nu JOIN st USING (src, tgt))"""
)


@query(f"WITH {ZED} SELECT tgt, {R('sum(z) / sqrt(count(DISTINCT src))')} AS stouffer FROM rz GROUP BY ALL")
def stouffer_z(spark, sf_dir):
    real, null = real_and_null(spark, sf_dir)
    return rounded(surrogates.stouffer(surrogates.null_z(real, null, ["src", "tgt"]), ["tgt"], "src"), "stouffer")


@query(f"WITH {ZED}, s AS (SELECT tgt, k, sum(z) AS s, count(DISTINCT src) AS c FROM nz GROUP BY ALL) SELECT {R('max(c) * max(c) / greatest(var_samp(s), 1e-4)')} AS c_eff, {R('sqrt(greatest(var_samp(s), 1e-4))')} AS divisor FROM s")
def stouffer_whitened(spark, sf_dir):
    _, null = real_and_null(spark, sf_dir)
    z = surrogates.null_z(null, null, ["src", "tgt"])
    return rounded(surrogates.covariance_sum(z, "src", ["tgt", "k"]), "c_eff", "divisor")


@query(
    f"""WITH {ZED}, t AS (SELECT tgt, max(z) AS max_stat FROM rz GROUP BY ALL), n AS (SELECT tgt, k, max(z) AS z FROM nz GROUP BY ALL)
SELECT tgt, {R("max_stat")} AS max_stat, {R("(sum(CASE WHEN n.z >= max_stat THEN 1 ELSE 0 END) + 1) / (count(*) + 1)")} AS p FROM t JOIN n USING (tgt) GROUP BY tgt, max_stat"""
)
def max_t_combined(spark, sf_dir):
    real, null = real_and_null(spark, sf_dir)
    keys = ["src", "tgt"]
    return rounded(surrogates.max_t(surrogates.null_z(real, null, keys), surrogates.null_z(null, null, keys), ["tgt"], "k"), "max_stat", "p")


_SCAN = ", ".join(f"CASE WHEN row_number() OVER w >= {n} THEN sum(z) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / sqrt({n}) END AS w{n}" for n in (4, 8, 16))


@query(f"WITH {Z}, s AS (SELECT modality, {_SCAN} FROM z WINDOW w AS (PARTITION BY modality ORDER BY b)) SELECT modality, {R('greatest(max(w4), max(w8), max(w16))')} AS scan_max FROM s GROUP BY ALL")
def scan_window_max(spark, sf_dir):
    return rounded(localize.scan_max(zgrid(spark, sf_dir), M, "z", (4, 8, 16)), "scan_max")


@query(
    f"""WITH {Z}, o AS (SELECT modality, z, b - row_number() OVER (PARTITION BY modality ORDER BY b) AS r FROM z WHERE z > 0.5), m AS (SELECT modality, r, sum(z - 0.5) AS mass FROM o GROUP BY ALL)
SELECT s.modality, {R("coalesce(max(mass), 0.0)")} AS max_mass FROM (SELECT DISTINCT modality FROM z) s LEFT JOIN m USING (modality) GROUP BY ALL"""
)
def cluster_mass(spark, sf_dir):
    return rounded(localize.cluster_mass(zgrid(spark, sf_dir), M, "z", 0.5), "max_mass")


@query(
    f"""WITH {Z}, g AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY modality ORDER BY b) IS NULL THEN 0 ELSE z - 0.1 END AS f, CASE WHEN lead(b) OVER (PARTITION BY modality ORDER BY b) IS NULL THEN 0 ELSE z - 0.1 END AS h FROM z),
s AS (SELECT *, sum(f) OVER (PARTITION BY modality ORDER BY b ROWS UNBOUNDED PRECEDING) AS sf, sum(h) OVER (PARTITION BY modality ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS sh FROM g)
SELECT modality, b, {R("sf - min(sf) OVER (PARTITION BY modality ORDER BY b ROWS UNBOUNDED PRECEDING)")} AS forward, {R("sh - min(sh) OVER (PARTITION BY modality ORDER BY b DESC ROWS UNBOUNDED PRECEDING)")} AS backward FROM s"""
)
def cusum_bilateral(spark, sf_dir):
    rows = zgrid(spark, sf_dir).withColumn("centre", F.lit(0.0))
    return rounded(localize.cusum(rows, M, "z", "centre", 0.1).select("modality", "b", "forward", "backward"), "forward", "backward")


RUNS = ACT + """, fl AS (SELECT *, activity > 0.7 AS up FROM act), tn AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY modality ORDER BY b) THEN 0 ELSE 1 END AS turn FROM fl),
rn AS (SELECT *, sum(turn) OVER (PARTITION BY modality ORDER BY b ROWS UNBOUNDED PRECEDING) AS r FROM tn), ln AS (SELECT *, count(*) OVER (PARTITION BY modality, r) AS len FROM rn)"""


@query(f"WITH {RUNS} SELECT modality, b, up, up AND len >= 3 AS kept FROM ln")
def min_event_filter(spark, sf_dir):
    rows = agrid(spark, sf_dir).withColumn("up", F.col("activity") > 0.7)
    return localize.min_event_filter(rows, M, "up", 3).select("modality", "b", "up", "kept")


@query(f"WITH {RUNS}, f AS (SELECT modality, r, min(b) AS start, count(*) AS length FROM ln WHERE up GROUP BY ALL HAVING count(*) >= 3) SELECT modality, start, length FROM f QUALIFY row_number() OVER (PARTITION BY modality ORDER BY length DESC, start) = 1")
def valid_window(spark, sf_dir):
    return localize.valid_window(agrid(spark, sf_dir).withColumn("up", F.col("activity") > 0.7), M, "up", 3)


_L = "10.0 * ln(1 / (1 - least(greatest(r2, -0.99), 0.99)))"
LLR = (
    SHIFTED
    + f""", sq AS (SELECT modality AS channel, -1 AS k, b, z * z / 40 AS r2 FROM z UNION ALL SELECT modality, k, b, x_shifted * x_shifted / 40 FROM su), l AS (SELECT channel, k, b, {_L} AS l FROM sq),
st AS (SELECT channel, b, avg(l) AS m, stddev_pop(l) AS s FROM l WHERE k >= 0 GROUP BY ALL), zz AS (SELECT channel, k, b, CASE WHEN s > 1e-12 THEN (l - m) / s ELSE 0 END AS z FROM l JOIN st USING (channel, b)),
wt AS (SELECT channel, greatest(avg(z), 0) / greatest(var_pop(z), 1e-12) AS w FROM zz WHERE k = -1 GROUP BY ALL), po AS (SELECT k, b, sum(CASE WHEN t > 0 THEN w / t * z ELSE 0 END) AS p FROM zz JOIN wt USING (channel), (SELECT sum(w) AS t FROM wt) GROUP BY ALL),
sm AS (SELECT k, b, greatest(avg(p) OVER (PARTITION BY k ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), avg(p) OVER (PARTITION BY k ORDER BY b ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS score FROM po),
cut AS (SELECT greatest(quantile_cont(t, 0.9), 0.5) AS threshold FROM (SELECT k, max(score) AS t FROM sm WHERE k >= 0 GROUP BY k))"""
)


def squares(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(channel, b, r2) and (channel, k, b, r2): squares of the streams in place of explained variance, real and shifted."""
    z = zgrid(spark, sf_dir)
    real = z.select(F.col("modality").alias("channel"), "b", (F.col("z") * F.col("z") / 40).alias("r2"))
    return real, shifted(z, spark).select(F.col("modality").alias("channel"), "k", "b", (F.col("x_shifted") * F.col("x_shifted") / 40).alias("r2"))


@query(f"WITH {LLR} SELECT b, {R('score')} AS score, {R('threshold')} AS threshold, score > threshold AS masked FROM sm, cut WHERE k = -1")
def llr_mrc_mask(spark, sf_dir):
    return rounded(localize.llr_mask(*squares(spark, sf_dir), "channel", 20.0, (1, 3), floor=0.5), "score", "threshold")


@query(
    f"""WITH {LLR}, u AS (SELECT b, score, threshold, score > threshold AS u FROM sm, cut WHERE k = -1), r AS (SELECT *, b - row_number() OVER (PARTITION BY u ORDER BY b) AS r FROM u), n AS (SELECT *, u AND count(*) OVER (PARTITION BY u, r) >= 2 AS kept FROM r)
SELECT b, {R("score")} AS score, {R("threshold")} AS threshold, kept AS masked, kept::INT::DOUBLE AS posterior FROM n"""
)
def llr_localization(spark, sf_dir):
    return rounded(localize.llr_localization(*squares(spark, sf_dir), "channel", 20.0, (1, 3), 2, floor=0.5), "score", "threshold")


IV = (
    EV
    + """, du AS (SELECT user_id AS session_id, max(t) AS duration FROM ev GROUP BY ALL), mk AS (SELECT user_id AS session_id, t, modality = 'signup' AS st, CASE WHEN modality = 'signup' THEN 'active_start' ELSE 'active_stop' END AS label FROM ev WHERE modality IN ('signup', 'purchase')),
ch AS (SELECT *, lag(st) OVER w AS bs, lag(t) OVER w AS bt, lead(t) OVER w AS nxt FROM mk WINDOW w AS (PARTITION BY session_id ORDER BY t, label)),
iv AS (SELECT session_id, 'active' AS condition, greatest(t0, 0.0) AS t_start, least(coalesce(t1, duration), duration) AS t_stop FROM (SELECT session_id, bt AS t0, t AS t1 FROM ch WHERE NOT st AND coalesce(bs, false) UNION ALL SELECT session_id, t, NULL FROM ch WHERE st AND nxt IS NULL) JOIN du USING (session_id) WHERE least(coalesce(t1, duration), duration) > greatest(t0, 0.0))"""
)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = streams.samples(spark, sf_dir).groupBy(F.col("user_id").alias("session_id")).agg(F.max("t").alias("duration"))
    return conditions.condition_intervals(streams.markers(spark, sf_dir), durations)


@query(f"WITH {IV} SELECT session_id, condition, {R('t_start')} AS t_start, {R('t_stop')} AS t_stop FROM iv")
def condition_intervals(spark, sf_dir):
    return rounded(intervals(spark, sf_dir), "t_start", "t_stop")


CLS = IV + """, ts AS (SELECT user_id AS session_id, t, max(x) FILTER (modality = 'click') AS a, max(x) FILTER (modality = 'view') AS v FROM ev GROUP BY ALL),
lb AS (SELECT session_id, t, coalesce(a, 0.0) AS a, coalesce(v, 0.0) AS b, CAST(coalesce(a, 0.0) > 10 AS INT) + 2 * CAST(coalesce(v, 0.0) > 10 AS INT) AS label FROM ts)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda m: F.coalesce(F.max(F.when(F.col("modality") == m, F.col("x"))), F.lit(0.0))
    rows = streams.samples(spark, sf_dir).groupBy(F.col("user_id").alias("session_id"), "t").agg(pick("click").alias("a"), pick("view").alias("b"))
    return rows.withColumn("label", conditions.classify(F.col("a"), F.col("b"), F.lit(10), F.lit(10)))


@query(f"WITH {CLS} SELECT session_id, label, count(*) AS n FROM lb GROUP BY ALL")
def classify_conditions(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("session_id", "label").agg(F.count("*").alias("n"))


FAN = (
    CLS
    + """, ins AS (SELECT DISTINCT lb.*, condition FROM lb JOIN iv ON lb.session_id = iv.session_id AND lb.t BETWEEN t_start AND t_stop),
fan AS (SELECT * FROM ins UNION ALL SELECT lb.*, 'uncategorized' FROM lb WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.session_id = lb.session_id AND ins.t = lb.t) UNION ALL SELECT lb.*, 'all' FROM lb),
cs AS (SELECT session_id, condition, count(*) AS n, count(*) * 60.0 AS duration, avg((label = 0)::INT) * 100 AS pct_none, avg((label = 1)::INT) * 100 AS pct_a, avg((label = 2)::INT) * 100 AS pct_b, avg((label = 3)::INT) * 100 AS pct_both, avg(a) AS mean_a, avg(b) AS mean_b, max(greatest(a, b)) AS peak FROM fan GROUP BY ALL)"""
)
_STATS = ["duration", "pct_none", "pct_a", "pct_b", "pct_both", "mean_a", "mean_b", "peak"]


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.condition_stats(labelled(spark, sf_dir), intervals(spark, sf_dir), 60.0, 86400.0)


@query(f"WITH {FAN} SELECT session_id, condition, n, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in _STATS) + " FROM cs")
def condition_stats(spark, sf_dir):
    out = stats(spark, sf_dir)
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in _STATS})


@query(f"WITH {FAN} SELECT condition, {R('avg(mean_a)')} AS grand_mean, {R('stddev_pop(mean_a)')} AS grand_sd, count(mean_a) AS n_sessions FROM cs GROUP BY ALL")
def grand_condition_summary(spark, sf_dir):
    return rounded(conditions.grand_summary(stats(spark, sf_dir), "mean_a"), "grand_mean", "grand_sd")


@query(f"WITH {ACT} SELECT modality, {R('quantile_cont(activity, 0.25)')} AS cut FROM act GROUP BY ALL")
def adaptive_threshold(spark, sf_dir):
    return rounded(conditions.adaptive_cut(agrid(spark, sf_dir), M, "activity", 0.25), "cut")


@query("SELECT l_partkey AS feature, c_mktsegment AS pathway, count(DISTINCT c_custkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 4")
def feature_consistency(spark, sf_dir):
    o, c = streams.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), streams.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = streams.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return discovery.consistency(rows.select(F.col("l_partkey").alias("feature"), F.col("c_mktsegment").alias("pathway"), "c_custkey"), ["feature", "pathway"], "c_custkey", 4)


_MODS = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {PAIRS}, rd AS ({RIDGE}) SELECT src, " + ", ".join(f"{R(f'''max(r2) FILTER (tgt = '{m}')''')} AS to_{m}" for m in _MODS) + " FROM rd GROUP BY ALL")
def coupling_matrix_pivot(spark, sf_dir):
    r2 = regression.ridge_1d(pair_rows(spark, sf_dir), ["src", "tgt"], "x", "y", 1e-3)
    wide = r2.groupBy("src").pivot("tgt", list(_MODS)).agg(F.max("r2"))
    return wide.select("src", *[r6(m).alias(f"to_{m}") for m in _MODS])


@query(
    f"""WITH s AS (SELECT quality AS y, n_chars AS v FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, avg(rn) OVER (PARTITION BY v) AS rk FROM (SELECT y, v, row_number() OVER (ORDER BY v) AS rn FROM s))
SELECT {R("(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))")} AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM r"""
)
def roc_auc(spark, sf_dir):
    rows = streams.table(spark, sf_dir, "labels").select("doc_id", "quality").join(streams.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(metrics.roc_auc(rows, "quality", "n_chars"), "auc")


@query(
    f"""WITH {ACT}, tf AS (SELECT modality, abs(z) > 0.8 AS t, activity > 0.8 AS f, abs(z) AS g, activity AS p FROM act)
SELECT modality, {R("sum((t AND f)::INT) / sum(t::INT)")} AS hit_rate, {R("sum((NOT t AND f)::INT) / sum((NOT t)::INT)")} AS false_alarm, {R("sum((t AND f)::INT) / sum((t OR f)::INT)")} AS iou, {R("corr(g, p)")} AS r, {R("avg(t::INT)")} AS duty_true, {R("avg(f::INT)")} AS duty_found FROM tf GROUP BY ALL"""
)
def timing_metrics(spark, sf_dir):
    rows = agrid(spark, sf_dir).select("modality", (F.abs("z") > 0.8).alias("truth"), (F.col("activity") > 0.8).alias("found"), F.abs("z").alias("gate"), "activity")
    return rounded(metrics.timing(rows, M, "truth", "found", "gate", "activity"), "hit_rate", "false_alarm", "iou", "r", "duty_true", "duty_found")


@query(
    f"""WITH s AS (SELECT CASE WHEN n_chars >= 0 AND n_chars < 500 THEN 0 WHEN n_chars >= 500 AND n_chars < 2000 THEN 1 WHEN n_chars >= 2000 AND n_chars < 1e9 THEN 2 END AS bin, toxic = 1 AS p, quality = 1 AS h FROM labels JOIN documents USING (doc_id))
SELECT bin, count(*) AS n, {R("sum((p AND h)::INT) / nullif(sum(p::INT), 0)")} AS tpr, {R("sum((NOT p AND h)::INT) / nullif(sum((NOT p)::INT), 0)")} AS fpr FROM s WHERE bin IS NOT NULL GROUP BY ALL"""
)
def kappa_bin_rates(spark, sf_dir):
    rows = streams.table(spark, sf_dir, "labels").join(streams.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    flagged = rows.select("n_chars", (F.col("quality") == 1).alias("hit"), (F.col("toxic") == 1).alias("positive"))
    return rounded(metrics.rates_by_bin(flagged, "n_chars", (0, 500, 2000, 1e9), "hit", "positive"), "tpr", "fpr")


@query("SELECT conv_id, CASE WHEN bool_or(contains(lower(coalesce(text, '')), 'tion')) THEN 'patient' ELSE 'therapist' END AS role FROM conversations GROUP BY ALL")
def role_detection(spark, sf_dir):
    return streams.detect_roles(streams.table(spark, sf_dir, "conversations"), "conv_id", "text", "tion")


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, tgt, b, valid, c0.., ar1.., y): lag features of each stream for each other stream's target."""
    z = zgrid(spark, sf_dir)
    src = temporal.lag_convolution(z, M, BASIS.tolist()).withColumnRenamed("modality", "src")
    tgt = temporal.ar_terms(z, M, 3).withColumnsRenamed({"modality": "tgt", "z": "y"}).join(z.select(F.col("modality").alias("tgt"), "b", "valid"), ["tgt", "b"])
    return src.join(tgt, "b").where("src <> tgt")


SOURCE, OWN = ["c0", "c1", "c2"], ["ar1", "ar2", "ar3"]


@query()
def lag_regression_dr2(spark, sf_dir):
    return regression.nested_ridge(design(spark, sf_dir), ["src", "tgt"], SOURCE, OWN, "y")


@query()
def ewls_dr2(spark, sf_dir):
    return regression.ewls(design(spark, sf_dir), ["src", "tgt"], SOURCE, OWN, "y", 0.9)


@query()
def group_lasso_select(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return regression.group_lasso(regression.moments(rows, ["tgt"], [*columns, "y"]), ["tgt"], groups, 0.05)


@query()
def hmm_coupling(spark, sf_dir):
    return states.hmm_posterior(agrid(spark, sf_dir), M, "activity", 0.5)


@query()
def hsmm_posterior(spark, sf_dir):
    return episodes.hsmm_posterior(agrid(spark, sf_dir), M, "activity", 0.5)


@query()
def kim_posterior(spark, sf_dir):
    return switching.switching(design(spark, sf_dir), ["src"], "tgt", "y", SOURCE, valid="valid")[0]


@query(
    f"""WITH RECURSIVE {ACT}, sq AS (SELECT modality, list(activity ORDER BY b) AS x, count(*) AS n, 2 * ln(greatest(count(*), 2)) * greatest(var_pop(activity), 1e-12) AS pen FROM act GROUP BY ALL),
pf AS (SELECT modality, n, pen, list_prepend(0.0::DOUBLE, list_transform(range(1, n + 1), lambda i: list_sum(x[1:i]))) AS s, list_prepend(0.0::DOUBLE, list_transform(range(1, n + 1), lambda i: list_sum(list_transform(x[1:i], lambda v: v * v)))) AS q FROM sq),
dp AS (SELECT modality, 0 AS t, [-pen] AS best, []::INT[] AS cut FROM pf UNION ALL
SELECT modality, t + 1, list_append(best, list_min(c) + pen), list_append(cut, CAST(list_position(c, list_min(c)) - 1 AS INT)) FROM (
  SELECT dp.modality, t, best, cut, pen, list_transform(range(0, t + 1), lambda a: best[a + 1] + (q[t + 2] - q[a + 1]) - (s[t + 2] - s[a + 1]) * (s[t + 2] - s[a + 1]) / (t + 1 - a)) AS c FROM dp JOIN pf USING (modality) WHERE t < n)),
bt AS (SELECT modality, cut, cut[n] AS p FROM dp JOIN pf USING (modality) WHERE t = n UNION ALL SELECT modality, cut, cut[p] FROM bt WHERE p > 0),
sg AS (SELECT act.modality, act.b, activity, CAST(count(*) FILTER (bt.p <= act.b) - 1 AS INT) AS segment FROM act JOIN bt ON bt.modality = act.modality GROUP BY ALL)
SELECT modality, b, segment, {R("avg(activity) OVER (PARTITION BY modality, segment)")} AS mean FROM sg"""
)
def pelt_segments(spark, sf_dir):
    return rounded(episodes.pelt_segments(agrid(spark, sf_dir), M, "activity"), "mean")


@query()
def gpd_pvalue(spark, sf_dir):
    z = agrid(spark, sf_dir)
    draws = shifted(z.select("modality", "b", "valid", F.col("activity").alias("z")), spark).groupBy("modality", "b").agg(F.sort_array(F.collect_list("x_shifted")).alias("nulls"))
    return states.gpd_pvalues(z.join(draws, ["modality", "b"]), M, "activity", "nulls")


_PH = "(2 * pi() * CAST('0x' || substr(md5(k || ':' || f), 1, 8) AS BIGINT) / pow(2, 32))"


@query(
    f"""WITH {Z}, le AS (SELECT max(b) + 1 AS le FROM z), ff AS (SELECT CAST(unnest(range(0, (SELECT le // 2 + 1 FROM le))) AS BIGINT) AS f),
sp AS (SELECT modality, f, sum(z * cos(2 * pi() * f * b / le)) AS re, -sum(z * sin(2 * pi() * f * b / le)) AS im FROM z, ff, le GROUP BY ALL),
ph AS (SELECT k, f, CASE WHEN f = 0 OR 2 * f = le THEN 0.0 ELSE {_PH} END AS a, CASE WHEN f = 0 OR 2 * f = le THEN 1.0 ELSE 2.0 END AS m FROM ff, le, range(3) r(k))
SELECT z.modality, CAST(k AS INT) AS k, z.b, {R("sum(m * (re * cos(a + 2 * pi() * f * z.b / le) - im * sin(a + 2 * pi() * f * z.b / le)) / le)")} AS surrogate FROM z JOIN sp USING (modality) JOIN ph USING (f), le GROUP BY z.modality, k, z.b"""
)
def fourier_surrogates(spark, sf_dir):
    """By two passes each way where a stream has over 50 rows."""
    return rounded(spectra.fourier_surrogates(zgrid(spark, sf_dir), M, "z", 3, whole=50), "surrogate")


_SH = (7, 20, 45, 60)


@query(
    f"""WITH {PAIRS}, la AS (SELECT modality, b, coalesce(lag(z) OVER (PARTITION BY modality ORDER BY b), 0.0) AS o FROM z), dd AS (SELECT pr.src, pr.tgt, pr.b, pr.x, la.o, pr.y FROM pr JOIN la ON la.modality = pr.tgt AND la.b = pr.b WHERE pr.src <> pr.tgt), n AS (SELECT max(b) + 1 AS n FROM z),
mo AS (SELECT t.src, t.tgt, s, sum(h.x * h.x) AS xx, sum(h.x * t.o) AS xo, sum(t.o * t.o) AS oo, sum(h.x * t.y) AS xy, sum(t.o * t.y) AS oy, sum(t.y * t.y) AS yy, sum(t.y * t.y) - pow(sum(t.y), 2) / count(*) AS tot FROM dd t CROSS JOIN (SELECT unnest([0, {', '.join(map(str, _SH))}]) AS s) CROSS JOIN n JOIN dd h ON h.src = t.src AND h.tgt = t.tgt AND h.b = (t.b - s + n) % n GROUP BY ALL),
be AS (SELECT *, ((oo + 0.001) * xy - xo * oy) / ((xx + 0.001) * (oo + 0.001) - xo * xo) AS b1, ((xx + 0.001) * oy - xo * xy) / ((xx + 0.001) * (oo + 0.001) - xo * xo) AS b2, oy / (oo + 0.001) AS b0 FROM mo),
st AS (SELECT src, tgt, s, round(CASE WHEN tot > 1e-10 THEN least(greatest(1 - (yy - 2 * (b1 * xy + b2 * oy) + b1 * b1 * xx + 2 * b1 * b2 * xo + b2 * b2 * oo) / tot, -1), 1) - least(greatest(1 - (yy - 2 * b0 * oy + b0 * b0 * oo) / tot, -1), 1) ELSE 0.0 END, 9) AS stat FROM be)
SELECT r.src, r.tgt, {R("r.stat")} AS stat, count(*) AS n_null, {R("(sum((v.stat >= r.stat)::INT) + 1) / (count(*) + 1)")} AS p FROM st r JOIN st v ON v.src = r.src AND v.tgt = r.tgt AND v.s <> 0 WHERE r.s = 0 GROUP BY r.src, r.tgt, r.stat"""
)
def design_shift_pvalue(spark, sf_dir):
    z = zgrid(spark, sf_dir)
    own = temporal.ar_terms(z, M, 1).select(F.col("modality").alias("tgt"), "b", F.col("ar1").alias("o"))
    rows = pair_rows(spark, sf_dir).where("src <> tgt").join(own, ["tgt", "b"])
    return rounded(spectra.shift_test(rows, ["src", "tgt"], ["x"], ["o"], "y", _SH), "stat", "p")


@query()
def channel_shift_pvalue(spark, sf_dir):
    """Three lag features and a past of three against thirty shifts, each pathway on its own."""
    return spectra.shift_test(design(spark, sf_dir), ["src", "tgt"], SOURCE, OWN, "y", range(15, 105, 3))


@query()
def wavelet_power(spark, sf_dir):
    return wavelets.morlet_power(zgrid(spark, sf_dir), M, "z", 4.0, (0.25, 0.5, 1.0))


@query(f"WITH {Z} SELECT modality, b, {R('avg(z) OVER (PARTITION BY modality ORDER BY b ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS smooth FROM z")
def smooth_centered(spark, sf_dir):
    return rounded(temporal.smooth(zgrid(spark, sf_dir), M, 2, "z").select("modality", "b", "smooth"), "smooth")


@query(f"WITH {Z}, w AS (SELECT modality, b, z, unnest(range(greatest(0, CAST(ceil((b - 11) / 4.0) AS INT)), b // 4 + 1)) AS w FROM z) SELECT modality, CAST(w AS INT) AS w, count(*) AS n, {R('avg(z)')} AS mean FROM w GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    return rounded(signals.windows(zgrid(spark, sf_dir), 12, 4).groupBy("modality", "w").agg(F.count("*").alias("n"), F.avg("z").alias("mean")), "mean")


BEATS = (
    EV
    + """, pk AS (SELECT modality, avg(x) + 0.5 * stddev_pop(x) AS cut FROM ev GROUP BY ALL),
mk AS (SELECT modality, t, x, cut, max(x) OVER (PARTITION BY modality ORDER BY t RANGE BETWEEN 900 PRECEDING AND 900 FOLLOWING) AS top, lag(x) OVER w AS p, lead(x) OVER w AS q FROM ev JOIN pk USING (modality) WINDOW w AS (PARTITION BY modality ORDER BY t)),
pe AS (SELECT modality, t FROM mk WHERE x >= cut AND x = top AND x > p AND x >= q), bt AS (SELECT modality, t, CASE WHEN lag(t) OVER w IS NOT NULL THEN least(greatest(t - lag(t) OVER w, 0.3), 2.0) END AS ibi FROM pe WINDOW w AS (PARTITION BY modality ORDER BY t))"""
)


@query(f"WITH {BEATS} SELECT modality, {R('t')} AS t, {R('ibi')} AS ibi FROM bt")
def beats(spark, sf_dir):
    return rounded(signals.beats(streams.samples(spark, sf_dir), M, "x", 0.5, 900.0), "t", "ibi")


@query(f"WITH {BEATS} SELECT modality, {R('t')} AS t, {R('60 / avg(ibi) OVER (PARTITION BY modality ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)')} AS hr FROM bt")
def heart_rate(spark, sf_dir):
    return rounded(signals.heart_rate(signals.beats(streams.samples(spark, sf_dir), M, "x", 0.5, 900.0), M, 86400.0).select("modality", "t", "hr"), "t", "hr")


_P = "least(greatest(p, 1e-12), 1 - 1e-12)"


@query(f"WITH {STAT}, r AS (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY p, src) AS i, count(*) OVER (PARTITION BY tgt) AS n FROM pv) SELECT tgt, {R(f'max(sqrt(n) * (i / n - {_P}) / sqrt({_P} * (1 - {_P})))')} AS hc FROM r WHERE i <= greatest(n // 2, 1) GROUP BY ALL")
def higher_criticism(spark, sf_dir):
    tests = surrogates.empirical_p(*real_and_null(spark, sf_dir), ["src", "tgt"])
    return rounded(selection.higher_criticism(tests, ["tgt"], ["src"]), "hc")


@query(f"WITH {ACT} SELECT modality, {R('avg(z) FILTER (activity > 0.8)')} AS inside, {R('avg(z) FILTER (NOT activity > 0.8)')} AS outside, {R('avg(z) FILTER (activity > 0.8) - avg(z) FILTER (NOT activity > 0.8)')} AS difference FROM act GROUP BY ALL")
def masked_breakdown(spark, sf_dir):
    return rounded(localize.masked_breakdown(agrid(spark, sf_dir).withColumn("on", F.col("activity") > 0.8), M, "z", "on"), "inside", "outside", "difference")


BANDS = {"slow": (0.0, 0.5), "fast": (0.5, 2.0)}


_FT = """, se AS (SELECT {keys}, w, s, b - 8 * w - s AS j, {cols} FROM wn, (SELECT unnest([0, 8, 16]) AS s) WHERE b - 8 * w - s BETWEEN 0 AND 15),
hn AS (SELECT {keys}, w, s, j, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS h, {centred} FROM se),
ft AS (SELECT {keys}, w, s, k, {sums} FROM hn, (SELECT unnest(range(9)) AS k) GROUP BY ALL)"""
_WN = "wn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, w) AS nw FROM (SELECT *, CAST(unnest(range(greatest(0, CAST(ceil((b - 31) / 8.0) AS INT)), b // 8 + 1)) AS INT) AS w FROM {source})) WHERE nw = 32)"


def _fourier(keys: str, source: str, values: dict[str, str]) -> str:
    """CTEs of the Fourier sums of Welch segments: 16 rows, half overlap, means out, Hann window."""
    cols = ", ".join(f"{v} AS {c}" for c, v in values.items())
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {keys}, w, s) AS {c}" for c in values)
    sums = ", ".join(f"sum(h * {c} * cos(2 * pi() * k * j / 16)) AS {c}r, -sum(h * {c} * sin(2 * pi() * k * j / 16)) AS {c}i" for c in values)
    return ", " + _WN.format(keys=keys, source=source) + _FT.format(keys=keys, cols=cols, centred=centred, sums=sums)


@query(f"WITH {Z}{_fourier('modality', 'z', {'z': 'z'})}, p AS (SELECT modality, w, k, avg(zr * zr + zi * zi) AS p FROM ft GROUP BY ALL) SELECT modality, w, {R('sum(p) FILTER (k <= 2)')} AS slow, {R('sum(p) FILTER (k >= 2)')} AS fast FROM p GROUP BY ALL")
def band_power(spark, sf_dir):
    return rounded(signals.band_power(zgrid(spark, sf_dir), M, "z", 32, 8, 4.0, BANDS), "slow", "fast")


@query(
    f"""WITH {PAIRS}, pp AS (SELECT * FROM pr WHERE src < tgt){_fourier("src, tgt", "pp", {"x": "x", "y": "y"})}, c AS (SELECT src, tgt, w, k, avg(xr * yr + xi * yi) AS cr, avg(xr * yi - xi * yr) AS ci, greatest(avg(xr * xr + xi * xi) * avg(yr * yr + yi * yi), 1e-20) AS p FROM ft GROUP BY ALL)
SELECT src, tgt, w, {R("avg((cr * cr + ci * ci) / p) FILTER (k <= 2)")} AS slow_msc, {R("avg(abs(ci) / sqrt(p)) FILTER (k <= 2)")} AS slow_imcoh, {R("avg((cr * cr + ci * ci) / p) FILTER (k >= 2)")} AS fast_msc, {R("avg(abs(ci) / sqrt(p)) FILTER (k >= 2)")} AS fast_imcoh FROM c GROUP BY ALL"""
)
def band_coherence(spark, sf_dir):
    out = signals.band_coherence(pair_rows(spark, sf_dir).where("src < tgt"), ["src", "tgt"], "x", "y", 32, 8, 4.0, BANDS)
    return rounded(out, "slow_msc", "slow_imcoh", "fast_msc", "fast_imcoh")


@query()
def filtered_stream(spark, sf_dir):
    return signals.filtered(zgrid(spark, sf_dir), M, "z", signals.butterworth(0.1, 1.0, 4.0), 64, 32)


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], list[str]]:
    """(tgt, b, lag features of every stream, y), the feature columns and their streams."""
    z = zgrid(spark, sf_dir)
    wide = temporal.lag_convolution(z, M, BASIS.tolist()).groupBy("b").pivot("modality", list(_MODS)).agg(*[F.max(c).alias(c) for c in SOURCE]).na.fill(0.0)
    columns = [f"{m}_{c}" for m in _MODS for c in SOURCE]
    return wide.join(z.select(F.col("modality").alias("tgt"), "b", F.col("z").alias("y")), "b"), columns, [c.rsplit("_", 1)[0] for c in columns]


@query()
def stability_selection(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return selection.stability(rows, ["tgt"], columns, groups, "y", 0.05)


@query()
def block_selection(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return selection.blocks(rows, ["tgt"], columns, groups, "y", 0.1, 30)


@query()
def pathway_decision(spark, sf_dir):
    rows, columns, groups = _wide(spark, sf_dir)
    return selection.decide(selection.stability(rows, ["tgt"], columns, groups, "y", 0.05), selection.blocks(rows, ["tgt"], columns, groups, "y", 0.1, 30), ["tgt"])


@query()
def embedding_components(spark, sf_dir):
    vectors = streams.table(spark, sf_dir, "embeddings")
    return signals.project(vectors, "embedding", signals.principal_components(vectors, "embedding", 64, 3)).select("vec_id", "pc0", "pc1", "pc2")


@query(
    f"""WITH {Z}, bk AS (SELECT modality, b // 8 AS k, count(*) AS n, min(b) AS low FROM z GROUP BY ALL), de AS (SELECT *, sum(n) OVER (PARTITION BY modality ORDER BY md5('1:' || k), k) - n AS dest FROM bk)
SELECT z.modality, CAST(dest + b - low AS INT) AS b, {R("z.z")} AS x_shuffled FROM z JOIN de ON de.modality = z.modality AND de.k = z.b // 8"""
)
def block_shuffle_surrogate(spark, sf_dir):
    return rounded(selection.block_shuffle(zgrid(spark, sf_dir).withColumn("x", F.col("z")), M, 8, 1), "x_shuffled")


@query()
def session_analysis(spark, sf_dir):
    return analysis.analyze(streams.samples(spark, sf_dir), ["modality"])
