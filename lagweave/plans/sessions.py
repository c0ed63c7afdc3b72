"""Queries of whole runs: sessions of two people, analysed in both directions, and the filters behind them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.functions.basis import raised_cosine
from lagweave.operators import coupling, episodes, reports, switching, wavelets
from lagweave.plans.more import ANALYTIC, values
from lagweave.plans.queries import _MODS, EV, PAIRS, R, pair_rows, query, rounded, squares, zgrid
from lagweave.sources import streams
from lagweave.sources.shared import shared_folder
from lagweave.streaming import causal, ordered


def people(spark: SparkSession, sf_dir: str, channels: int) -> DataFrame:
    """The event stream as sessions of two people: sessions and channels by user, modalities by type of event."""
    pair = F.floor(F.col("user_id") / 2)
    s = streams.samples(spark, sf_dir)
    return s.select(F.pmod(pair, F.lit(2)).cast("int").alias("session_id"), "participant", "modality", F.pmod(F.floor(pair / 2), F.lit(channels)).cast("int").alias("channel"), "t", "x")


def run(spark: SparkSession, sf_dir: str, channels: int, config: coupling.RunConfig) -> dict[str, DataFrame]:
    return coupling.analyze_both(people(spark, sf_dir, channels), f"{shared_folder(spark)}/lagweave-run-{uuid.uuid4().hex}", config)


PLAIN = coupling.RunConfig(n_basis=1, max_lag=4.0, ar_order=1, alpha=0.57, min_dr2=0.005, most_pairs=1, n_shifts=9, gamma=0.9, min_n=5, matched=False, detector="share")
_PHI = raised_cosine(1, 4.0, rate=1.0)[0][:, 0].tolist()
_STEPS = ", ".join(f"({s}, {v!r}::DOUBLE)" for s, v in enumerate(_PHI))
_KEYS = "session_id, direction, src, tgt"
SESSIONS = EV + f""", sm AS (SELECT CAST((user_id // 2) % 2 AS INT) AS session_id, participant, modality, t, x FROM ev),
sb AS (SELECT session_id, participant, modality, CAST(floor(t / 21600) AS INT) AS b, avg(x) AS x FROM sm GROUP BY ALL),
st AS (SELECT session_id, participant, modality, CAST(unnest(generate_series(0, (SELECT max(b) FROM sb))) AS INT) AS b FROM (SELECT DISTINCT session_id, participant, modality FROM sb)),
sg AS (SELECT st.*, x, x IS NOT NULL AS valid FROM st LEFT JOIN sb USING (session_id, participant, modality, b)),
ms AS (SELECT session_id, participant, modality, avg(x) AS m, stddev_pop(x) AS s FROM sg WHERE valid GROUP BY ALL),
sz AS (SELECT session_id, participant, modality, b, valid, CASE WHEN valid AND s > 1e-8 THEN least(greatest((x - m) / s, -10.0), 10.0) ELSE 0.0 END AS z FROM sg LEFT JOIN ms USING (session_id, participant, modality)),
phi(lag, v) AS (VALUES {_STEPS}),
so AS (SELECT g.session_id, CASE WHEN g.participant = 'p1' THEN 'p1-p2' ELSE 'p2-p1' END AS direction, g.modality AS src, g.b, sum(v * coalesce(h.z, 0.0)) AS x FROM sz g CROSS JOIN phi LEFT JOIN sz h ON h.session_id = g.session_id AND h.participant = g.participant AND h.modality = g.modality AND h.b = g.b - lag GROUP BY ALL),
ta AS (SELECT session_id, CASE WHEN participant = 'p2' THEN 'p1-p2' ELSE 'p2-p1' END AS direction, modality AS tgt, b, z AS y, valid::INT AS v, coalesce(lag(z) OVER (PARTITION BY session_id, participant, modality ORDER BY b), 0.0) AS o FROM sz),
di AS (SELECT {_KEYS}, round(abs(avg(x * y)), 9) AS score FROM so JOIN ta USING (session_id, direction, b) GROUP BY ALL HAVING round(abs(avg(x * y)), 9) >= {PLAIN.least_score}),
nb AS (SELECT max(b) + 1 AS n FROM sz),
sh AS (SELECT k, CASE WHEN k < 0 THEN 0 ELSE greatest(1, n // 10) + k * greatest(1, (n - 2 * greatest(1, n // 10)) // {PLAIN.n_shifts}) END AS s, n FROM nb, range(-1, {PLAIN.n_shifts}) r(k)),
mv AS (SELECT {_KEYS}, k, (b + s) % n AS b, x FROM so JOIN di USING (session_id, direction, src) CROSS JOIN sh),
ss AS (SELECT {_KEYS}, k, round(pow(avg(x * y), 2), 9) AS stat FROM mv JOIN ta USING (session_id, direction, tgt, b) GROUP BY ALL),
sp AS (SELECT {_KEYS}, (sum((a.stat >= r.stat)::INT) + 1) / (count(*) + 1) AS p FROM ss a JOIN (SELECT * EXCLUDE (k) FROM ss WHERE k < 0) r USING ({_KEYS}) WHERE k >= 0 GROUP BY ALL),
so2 AS (SELECT *, row_number() OVER (PARTITION BY session_id, direction ORDER BY p, src, tgt) AS r, count(*) OVER (PARTITION BY session_id, direction) AS m FROM sp),
sj AS (SELECT {_KEYS}, least(min(p * m / r) OVER (PARTITION BY session_id, direction ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS a FROM so2),
dd AS (SELECT {_KEYS}, b, x, y, o, v FROM so JOIN (SELECT * FROM sj WHERE a < {PLAIN.alpha}) USING (session_id, direction, src) JOIN ta USING (session_id, direction, tgt, b)),
ws AS (SELECT t.session_id, t.direction, t.src, t.tgt, t.b, any_value(t.x) AS x, any_value(t.o) AS o, any_value(t.y) AS y, sum(w) AS n, sum(w * s.y) AS sy, sum(w * s.x * s.x) AS xx, sum(w * s.x * s.o) AS xo, sum(w * s.o * s.o) AS oo, sum(w * s.x * s.y) AS xy, sum(w * s.o * s.y) AS oy
  FROM dd t JOIN (SELECT *, b AS sb FROM dd) s ON s.session_id = t.session_id AND s.direction = t.direction AND s.src = t.src AND s.tgt = t.tgt, LATERAL (SELECT s.v * CASE WHEN s.sb <= t.b THEN pow({PLAIN.gamma}, t.b - s.sb) ELSE pow({PLAIN.gamma}, s.sb - t.b - 1) END AS w) GROUP BY ALL),
wd AS (SELECT *, (xx + 0.001) * (oo + 0.001) - xo * xo AS det, y - sy / greatest(n, 1e-12) AS dv FROM ws), be AS (SELECT *, ((oo + 0.001) * xy - xo * oy) / det AS b1, ((xx + 0.001) * oy - xo * xy) / det AS b2, oy / (oo + 0.001) AS b0 FROM wd),
r2 AS (SELECT {_KEYS}, b, CASE WHEN dv * dv > 1e-10 THEN least(greatest(1 - pow(y - b1 * x - b2 * o, 2) / (dv * dv), -1.0), 1.0) ELSE 0.0 END - CASE WHEN dv * dv > 1e-10 THEN least(greatest(1 - pow(y - b0 * o, 2) / (dv * dv), -1.0), 1.0) ELSE 0.0 END AS d, n FROM be),
tc AS (SELECT {_KEYS}, b, CASE WHEN n >= {PLAIN.min_n} THEN d END AS dr2 FROM r2),
me AS (SELECT {_KEYS}, avg(dr2) AS mean_dr2, avg(CASE WHEN coalesce(round(dr2, 9), 0.0) > {PLAIN.min_dr2} THEN 1.0 ELSE 0.0 END) AS fraction FROM tc GROUP BY ALL),
ev2 AS (SELECT {_KEYS} FROM (SELECT DISTINCT session_id, direction, src FROM so) JOIN (SELECT DISTINCT session_id, direction, tgt FROM ta) USING (session_id, direction))"""
_DECIDED = f"a < {PLAIN.alpha} AND coalesce(mean_dr2, 0.0) >= -{PLAIN.min_dr2} AND coalesce(fraction, 0.0) >= {PLAIN.min_fraction}"


@query(f"WITH {SESSIONS} SELECT {_KEYS}, a IS NOT NULL AS found, {R('a')} AS p_adjusted, {R('mean_dr2')} AS mean_dr2, {R('fraction')} AS fraction, coalesce({_DECIDED}, false) AS significant FROM ev2 LEFT JOIN sj USING ({_KEYS}) LEFT JOIN me USING ({_KEYS})")
def run_pathways(spark, sf_dir):
    out = run(spark, sf_dir, 1, PLAIN)["pathways"]
    return rounded(out.select("session_id", "direction", "src", "tgt", "found", "p_adjusted", "mean_dr2", "fraction", "significant"), "p_adjusted", "mean_dr2", "fraction")


@query(f"WITH {SESSIONS} SELECT {_KEYS}, b, {R('dr2')} AS dr2 FROM tc")
def run_series(spark, sf_dir):
    return rounded(run(spark, sf_dir, 1, PLAIN)["series"].select("session_id", "direction", "src", "tgt", "b", "dr2"), "dr2")


@query()
def run_switching(spark, sf_dir):
    """Both directions with matched channels under one regime, products with a moderator, and episodes of a hidden state."""
    config = coupling.RunConfig(max_lag=4.0, ar_order=2, alpha=0.5, least_score=0.02, n_shifts=9, min_n=10, nonlinear=True, moderator="view")
    return run(spark, sf_dir, 2, config)["pathways"]


@query()
def run_sparse_discovery(spark, sf_dir):
    """Pairs of channels that group lasso keeps over half-samples and over blocks."""
    c = coupling.RunConfig(n_basis=2, max_lag=4.0, discovery="sparse", lasso=(0.02, 0.05), alpha=0.9, matched=False)
    z = coupling.signals(people(spark, sf_dir, 4), c)
    source, target = coupling.leading(z, c), coupling.led(z, c)
    scores = coupling.discover(source, target, coupling.RunConfig(n_basis=2, max_lag=4.0, least_score=0.0, most_pairs=1000, matched=False))
    kept = coupling.discover(source, target, c).select(*coupling.PAIR, F.lit(True).alias("kept"))
    return scores.join(kept, coupling.PAIR, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


_A = 0.95
ONE_ROUND = PAIRS + f""", rw AS (SELECT src, tgt, b, x, y, coalesce(lag(y) OVER (PARTITION BY src, tgt ORDER BY b), 0.0) AS p FROM pr WHERE src <> tgt),
fi AS (SELECT src, tgt, sum(p * y) / (sum(p * p) + 1e-6) AS a FROM rw WHERE b >= 1 GROUP BY ALL),
ow AS (SELECT src, tgt, any_value(a) AS a, greatest(var_pop(y - a * p), 1e-8) AS own FROM rw JOIN fi USING (src, tgt) WHERE b >= 1 GROUP BY ALL),
rm AS (SELECT src, tgt, greatest(sqrt(avg(x * x)), 1e-8) AS rms FROM rw GROUP BY ALL),
ob AS (SELECT src, tgt, b, CASE WHEN b >= 1 THEN y - a * p ELSE 0.0 END AS y, x / rms AS z, own FROM rw JOIN ow USING (src, tgt) JOIN rm USING (src, tgt)),
fl AS (SELECT src, tgt, b, 0.5::DOUBLE AS xi, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, own AS p0, own AS p1 FROM ob WHERE b = 0 UNION ALL
SELECT src, tgt, b, xn, w0 * m0 + (1 - w0) * mu, w1 * m0 + (1 - w1) * mu, w0 * (p0 + pow(m0 - (w0 * m0 + (1 - w0) * mu), 2)) + (1 - w0) * (pu + pow(mu - (w0 * m0 + (1 - w0) * mu), 2)), w1 * (p0 + pow(m0 - (w1 * m0 + (1 - w1) * mu), 2)) + (1 - w1) * (pu + pow(mu - (w1 * m0 + (1 - w1) * mu), 2)) FROM (
SELECT src, tgt, b, m0, p0, m1 + p1 * z / f * e AS mu, p1 - pow(p1 * z / f, 2) * f AS pu, {_A} * (1 - xi) / ({_A} * (1 - xi) + (1 - {_A}) * xi) AS w0, (1 - {_A}) * (1 - xi) / ((1 - {_A}) * (1 - xi) + {_A} * xi) AS w1,
  1 / (1 + exp(-0.5 * (ln(own) + y * y / own) + ln({_A} * (1 - xi) + (1 - {_A}) * xi) + 0.5 * (ln(f) + e * e / f) - ln((1 - {_A}) * (1 - xi) + {_A} * xi))) AS xn FROM (
SELECT *, y - z * m1 AS e, z * z * p1 + own AS f FROM (
SELECT ob.src, ob.tgt, ob.b, ob.y, ob.z, ob.own, fl.xi, fl.m0, fl.m1, least(fl.p0 + 1e-5, 10 * ob.own) AS p0, least(fl.p1 + 1e-5, 10 * ob.own) AS p1 FROM fl JOIN ob ON ob.src = fl.src AND ob.tgt = fl.tgt AND ob.b = fl.b + 1)))),
ls AS (SELECT max(b) AS l FROM ob),
bk AS (SELECT src, tgt, b, xi AS s FROM fl, ls WHERE b = l UNION ALL
SELECT src, tgt, b, s1 / (s0 + s1) FROM (SELECT fl.src, fl.tgt, fl.b, xi * ((1 - {_A}) * (1 - s) / ({_A} * (1 - xi) + (1 - {_A}) * xi) + {_A} * s / ((1 - {_A}) * (1 - xi) + {_A} * xi)) AS s1, (1 - xi) * ({_A} * (1 - s) / ({_A} * (1 - xi) + (1 - {_A}) * xi) + (1 - {_A}) * s / ((1 - {_A}) * (1 - xi) + {_A} * xi)) AS s0 FROM bk JOIN fl ON fl.src = bk.src AND fl.tgt = bk.tgt AND fl.b = bk.b - 1))"""


@query(f"WITH RECURSIVE {ONE_ROUND} SELECT src, tgt, b, {R('s')} AS posterior FROM bk")
def kim_one_round(spark, sf_dir):
    """One channel a pathway and one round, in chunks of 40 rows."""
    rows = pair_rows(spark, sf_dir).where("src <> tgt").withColumn("channel", F.lit("y"))
    return rounded(switching.switching(rows, ["src", "tgt"], "channel", "y", ["x"], order=1, rounds=1, chunk=40, run_in=20)[0], "posterior")


def beside(spark: SparkSession, sf_dir: str, modalities: tuple[str, ...]) -> DataFrame:
    return zgrid(spark, sf_dir).where(F.col("modality").isin(*modalities)).groupBy("b").pivot("modality", list(modalities)).agg(F.max("z")).withColumn("pair", F.lit("all"))


_CK = 6
LOCAL = f"""{ANALYTIC}, {values("g", wavelets.gaussian(5.0 * 4.0 / 0.5 / 6))}, nn AS (SELECT max(b) + 1 AS n FROM an),
sh AS (SELECT k, n, CASE WHEN k < 0 THEN 0 ELSE greatest(CAST(floor(n * 0.1) AS INT), 1) + k * greatest(CAST(floor((n - 2 * greatest(CAST(floor(n * 0.1) AS INT), 1)) / {_CK}.0) AS INT), 1) END AS s FROM nn, range(-1, {_CK}) r(k)),
pq AS (SELECT k, c.b, a.re * a.re + a.im * a.im AS xx, c.re * c.re + c.im * c.im AS yy, a.re * c.re + a.im * c.im AS sr, a.re * c.im - a.im * c.re AS si FROM an a CROSS JOIN sh JOIN an c ON c.b = (a.b + s) % n WHERE a.modality = 'click' AND c.modality = 'view'),
sm AS (SELECT p.k, p.b, sum(w * coalesce(q.xx, 0.0)) AS xx, sum(w * coalesce(q.yy, 0.0)) AS yy, sum(w * coalesce(q.sr, 0.0)) AS sr, sum(w * coalesce(q.si, 0.0)) AS si FROM pq p CROSS JOIN g LEFT JOIN pq q ON q.k = p.k AND q.b = p.b - lag WHERE p.b % 2 = 0 GROUP BY ALL),
co AS (SELECT k, b, sqrt((sr * sr + si * si) / greatest(xx * yy, 1e-20)) AS v FROM sm), cs AS (SELECT b, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS s FROM co WHERE k >= 0 GROUP BY ALL),
cz AS (SELECT k, b, (v - m) / s AS z FROM co JOIN cs USING (b)), ct AS (SELECT greatest(quantile_cont(top, 0.9), 1.0) AS cut FROM (SELECT k, max(z) AS top FROM cz WHERE k >= 0 GROUP BY ALL)),
up AS (SELECT b // 2 AS i, b, z, cut, z > cut AS u FROM cz, ct WHERE k < 0), ur AS (SELECT *, i - row_number() OVER (PARTITION BY u ORDER BY i) AS r FROM up), un AS (SELECT *, count(*) OVER (PARTITION BY u, r) AS len FROM ur)"""


@query(f"WITH {LOCAL} SELECT b, {R('z')} AS z, {R('1 / (1 + exp(-2 * (z - cut)))')} AS posterior, u AND len >= 2 AS masked FROM un")
def coherence_localization(spark, sf_dir):
    """Two streams, one frequency, every second bin, in spans of 32 rows."""
    out = wavelets.coherence_localization(beside(spark, sf_dir, ("click", "view")), ["pair"], ["click"], ["view"], 4.0, (0.5,), n_shifts=_CK, every=2, size=32)
    return rounded(out.select("b", "z", "posterior", "masked"), "z", "posterior")


@query()
def canonical_localization(spark, sf_dir):
    """Two sets of two streams at three frequencies."""
    return wavelets.coherence_localization(beside(spark, sf_dir, _MODS), ["pair"], ["click", "error"], ["purchase", "view"], 4.0, (0.25, 0.5, 1.0), n_shifts=20)


@query()
def hsmm_localization(spark, sf_dir):
    """Episodes in the pooled scores of all streams against their shifts, and whether they outlast those of the shifts."""
    real, null = (df.withColumn("pair", F.lit("all")) for df in squares(spark, sf_dir))
    post, found = episodes.hsmm_localization(real, null, ["pair"], "channel", "r2", 0.5, rounds=3)
    return post.join(found.select("pair", "threshold", "detected"), "pair")


RESULTS = """re AS (SELECT source AS sub, doc_id AS session, coalesce(lang, '-') AS modality, CAST(least(n_chars // 400, 9) AS DOUBLE) / 10 AS kappa, source AS pattern, toxic = 1 AS truth, quality = 0 AS found,
CASE WHEN toxic = 1 THEN n_chars / (n_chars + 1000.0) END AS auc, quality = 0 AND n_chars % 2 = 0 AS recovered FROM labels JOIN documents USING (doc_id)),
se AS (SELECT sub, modality, kappa, pattern, session, max((truth AND found)::INT) AS detected, max(coalesce(recovered, false)::INT) AS recovered, sum(auc) AS auc_sum, count(auc) AS auc_n FROM re GROUP BY ALL)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as results of a validation run: languages are modalities, lengths strengths, low quality is what was found."""
    docs = streams.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    at = streams.table(spark, sf_dir, "labels").join(docs, "doc_id")
    low = F.col("quality") == 0
    return at.select(
        F.col("source").alias("sub"), F.col("doc_id").alias("session"), F.coalesce("lang", F.lit("-")).alias("modality"), (F.least(F.floor(F.col("n_chars") / 400), F.lit(9)).cast("double") / 10).alias("kappa"),
        F.col("source").alias("pattern"), (F.col("toxic") == 1).alias("truth"), low.alias("found"), F.when(F.col("toxic") == 1, F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("auc"), (low & (F.col("n_chars") % 2 == 0)).alias("recovered"),
    )


@query(f"WITH {RESULTS} SELECT sub, sum((found AND NOT truth)::INT)::BIGINT AS n_alarms, count(*) AS n_pathways, {R('sum((found AND NOT truth)::INT) / count(*)')} AS rate, sum((found AND NOT truth)::INT) / count(*) <= 0.1 AS passed FROM re GROUP BY ALL")
def report_false_alarms(spark, sf_dir):
    return rounded(reports.false_alarms(outcomes(spark, sf_dir)), "rate")


@query(
    f"""WITH {RESULTS}, gs AS (SELECT modality, kappa, grouping(modality, kappa) AS g, count(*) AS n, avg(detected) AS rate, sum(auc_sum) / nullif(sum(auc_n), 0) AS auc FROM se GROUP BY GROUPING SETS ((modality, kappa), (modality), ())),
lk AS (SELECT modality, min(kappa) AS least_kappa FROM gs WHERE g = 0 AND rate >= 0.1 GROUP BY ALL) SELECT modality, kappa, n, {R("rate")} AS rate, {R("auc")} AS auc, CASE WHEN g < 3 THEN least_kappa END AS least_kappa FROM gs LEFT JOIN lk USING (modality)"""
)
def report_power_curve(spark, sf_dir):
    return rounded(reports.power_curve(outcomes(spark, sf_dir), 0.1), "rate", "auc")


@query(
    f"""WITH {RESULTS} SELECT modality, count(*) AS n, sum(detected)::BIGINT AS n_detected, sum(recovered)::BIGINT AS n_recovered, {R("sum(detected) / count(*)")} AS rate, sum(detected) / count(*) >= 0.1 AS passed FROM se GROUP BY ALL"""
)
def report_specificity(spark, sf_dir):
    return rounded(reports.specificity(outcomes(spark, sf_dir), ["modality"], 0.1), "rate")


@query(
    f"""WITH {RESULTS}, f AS (SELECT pattern, count(*) AS n, avg(detected) AS rate FROM se GROUP BY ALL) SELECT pattern, n, {R("rate")} AS rate, {R("avg(auc)")} AS auc, {R("min(auc)")} AS auc_least, {R("max(auc)")} AS auc_most, rate >= 0.1 AS passed FROM f JOIN re USING (pattern) GROUP BY pattern, n, rate"""
)
def report_patterns(spark, sf_dir):
    return rounded(reports.patterns(outcomes(spark, sf_dir), 0.1), "rate", "auc", "auc_least", "auc_most")


@query(
    f"""WITH {RESULTS} SELECT (SELECT count(*) FROM se WHERE sub = 'src0') AS n_forward, (SELECT coalesce(sum(detected), 0)::BIGINT FROM se WHERE sub = 'src0') AS n_detected,
(SELECT coalesce(sum((found AND NOT truth)::INT), 0)::BIGINT FROM re WHERE sub = 'src1') AS n_reverse_alarms, (SELECT coalesce(sum((found AND NOT truth)::INT), 0) FROM re WHERE sub = 'src1') <= 1 AS passed"""
)
def report_directionality(spark, sf_dir):
    return reports.directionality(outcomes(spark, sf_dir), "src0", "src1")


@query(
    """WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS mark FROM events), f AS (SELECT *, last_value(CASE WHEN mark <> 0 THEN mark END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, mark ROWS UNBOUNDED PRECEDING) AS m FROM e)
SELECT user_id, count(*) AS n, sum((coalesce(m, 0) > 0)::INT)::BIGINT AS n_active FROM f WHERE mark = 0 AND epoch_us(ts) <= (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events) GROUP BY ALL"""
)
def stream_conditions(spark, sf_dir):
    """Events between a sign-up and a purchase of their user, as the stream is replayed."""
    work = lambda rows: ordered.condition(rows.select(F.col("x").cast("long").alias("user_id"), "ts", F.when(F.col("modality") == "signup", 1).when(F.col("modality") == "purchase", -1).otherwise(0).alias("mark")), "user_id", "1 hour")
    out = causal.replayed(spark, f"{sf_dir}/events.parquet", work, "user_id")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("active").cast("long")).alias("n_active"))
