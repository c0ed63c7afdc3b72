"""Sessions of two people analysed in both directions as one stored run.

Each stage is a table of the run's folder, so a run that stopped goes on where it was, and each stage's decision
prunes what the next one scans: discovery keeps pairs of channels, the surrogate screen keeps pathways, only those
are estimated, and their time courses decide. Results are stored by session and direction.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.basis import raised_cosine
from lagweave.operators import pairs, regression, selection, stage2, states, surrogates, switching, temporal
from lagweave.operators.analysis import Config
from lagweave.sources import results

STREAM = ["session_id", "participant", "modality", "channel"]
SIDE = ["session_id", "direction"]
PATH = [*SIDE, "src", "tgt"]
PAIR = [*PATH, "src_channel", "tgt_channel"]


@dataclass(frozen=True)
class RunConfig(Config):
    """Parameters of a run.

    ``discovery`` is ``scores`` (lagged products of ``least_score`` or more) or ``sparse`` (channels that
    group lasso keeps over half-samples and over blocks). Pathways within a modality, if ``matched``, pair a channel
    with its own, and are estimated by one regime shared by their channels. ``nonlinear`` adds
    squares of the sources, ``moderator`` (a modality of the led person) products with its mean. Episodes
    come from an HMM or, with ``detector`` ``share``, are where variance is explained.
    """

    first: str = "p1"
    second: str = "p2"
    discovery: str = "scores"
    least_score: float = 0.05
    most_pairs: int = 8
    lasso: tuple[float, float] = (0.05, 0.1)
    block: int = 30
    n_shifts: int = 19
    gamma: float = 0.95
    min_n: float = 20
    matched: bool = True
    nonlinear: bool = False
    moderator: str | None = None
    detector: str = "hmm"
    cut: float = 0.5
    min_fraction: float = 0.03
    rate: float = 1.0
    both_ways: tuple[str, ...] = ()


def signals(samples: DataFrame, c: RunConfig) -> DataFrame:
    """(stream, b, valid, z) on the grid; ``samples`` (session_id, participant, modality, channel, t, x)."""
    rows = temporal.grid(samples.where(~F.col("modality").isin(list(c.excluded))), STREAM, c.bin_s)
    return temporal.zscore_clip(rows, STREAM).select(*STREAM, "b", "valid", "z")


def columns(c: RunConfig) -> list[str]:
    """Lag features of a source channel: of its values and, if asked for, of their squares."""
    return [f"c{j}" for j in range(c.n_basis)] + [f"q{j}" for j in range(c.n_basis)] * c.nonlinear


def leading(z: DataFrame, c: RunConfig) -> DataFrame:
    """(session_id, direction, src, src_channel, b, lag features): each person's streams where that person leads."""
    basis = raised_cosine(c.n_basis, c.max_lag, rate=1.0)[0].tolist()
    out = temporal.lag_convolution(z, STREAM, basis)
    if c.nonlinear:
        squares = temporal.lag_convolution(z.withColumn("z", F.col("z") * F.col("z") - 1), STREAM, basis)
        out = out.join(squares.withColumnsRenamed({f"c{j}": f"q{j}" for j in range(c.n_basis)}), [*STREAM, "b"])
    return pairs.both_directions(out, "participant", c.first, c.second)[0].withColumnsRenamed({"modality": "src", "channel": "src_channel"})


def led(z: DataFrame, c: RunConfig) -> DataFrame:
    """(session_id, direction, tgt, tgt_channel, b, valid, y, own past): each person's streams where the other leads."""
    own = temporal.ar_terms(z, STREAM, c.ar_order).join(z.select(*STREAM, "b", "valid"), [*STREAM, "b"])
    return pairs.both_directions(own, "participant", c.first, c.second)[1].withColumnsRenamed({"modality": "tgt", "channel": "tgt_channel", "z": "y"})


def discover(source: DataFrame, target: DataFrame, c: RunConfig) -> DataFrame:
    """(pair, score): the pairs of channels of each pathway that go on."""
    y = target.select(*SIDE, "tgt", "tgt_channel", "b", "y")
    met = source.join(y, [*SIDE, "b"])
    fits = (F.col("src") != F.col("tgt")) | (F.col("src_channel") == F.col("tgt_channel")) if c.matched else F.lit(True)
    size = [F.abs(F.avg(F.col(x) * F.col("y"))) for x in columns(c)]
    scores = met.where(fits).groupBy(*PAIR).agg(F.round(F.greatest(*size) if len(size) > 1 else size[0], 9).alias("score"))
    if c.discovery == "sparse":
        return scores.join(sparse(source, y, c), PAIR, "left_semi")
    best = Window.partitionBy(*PATH).orderBy(F.desc("score"), "src_channel", "tgt_channel")
    return scores.where(F.col("score") >= c.least_score).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= c.most_pairs).drop("_r")


def by_channel(source: DataFrame, channels: Sequence, c: RunConfig, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """(keys, b, a column for each channel and lag feature), the columns, and the channel of each; what is missing is 0."""
    names = [(f"s{i}_{x}", ch, x) for i, ch in enumerate(channels) for x in columns(c)]
    wide = source.groupBy(*keys, "b").agg(*[F.coalesce(F.max(F.when(F.col("src_channel") == ch, F.col(x))), F.lit(0.0)).alias(n) for n, ch, x in names])
    return wide, [n for n, _, _ in names], [str(ch) for _, ch, _ in names]


def channels_of(source: DataFrame) -> list:
    """The channel names that occur: the columns of a design, so a few tens at most; without any, one that doesn't."""
    return [r[0] for r in source.select("src_channel").distinct().orderBy("src_channel").collect()] or [0]


def sparse(source: DataFrame, y: DataFrame, c: RunConfig) -> DataFrame:
    """(pair): source channels that group lasso keeps for a target over half-samples and over blocks alike."""
    wide, names, groups = by_channel(source, channels_of(source), c, [*SIDE, "src"])
    rows, keys = wide.join(y, [*SIDE, "b"]), [*PATH, "tgt_channel"]
    stable = selection.stability(rows, keys, names, groups, "y", c.lasso[0])
    block = selection.blocks(rows, keys, names, groups, "y", c.lasso[1], c.block)
    chosen = selection.decide(stable, block, keys, c.alpha)
    return chosen.select(*keys, F.explode("selected").alias("src_channel")).select(*PAIR)


def screen(source: DataFrame, target: DataFrame, found: DataFrame, c: RunConfig) -> DataFrame:
    """(pathway, stat, n_null, p, p_adjusted, significant): squared lagged products of the found pairs against shifted sources.

    Only found channels are shifted, and each meets only its own targets.
    """
    n = source.agg(F.max("b")).first()[0]
    if n is None:
        n = 0
    low = max(1, int(0.1 * (n + 1)))
    step = max(1, (n + 1 - 2 * low) // max(1, c.n_shifts))
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0 if k < 0 else low + k * step).alias("s")) for k in range(-1, c.n_shifts)])
    some = source.join(found.select(*PAIR), [*SIDE, "src", "src_channel"])
    moved = some.withColumn("_s", F.explode(shifts)).select(*PAIR, F.col("_s.k").alias("k"), F.pmod(F.col("b") + F.col("_s.s"), F.lit(n + 1)).alias("b"), *columns(c))
    met = moved.join(target.select(*SIDE, "tgt", "tgt_channel", "b", "y"), [*SIDE, "tgt", "tgt_channel", "b"])
    each = met.groupBy(*PAIR, "k").agg(*[F.avg(F.col(x) * F.col("y")).alias(x) for x in columns(c)])
    stat = each.groupBy(*PATH, "k").agg(F.round(F.sum(sum((F.col(x) * F.col(x) for x in columns(c)), F.lit(0.0))), 9).alias("stat"))
    tests = surrogates.empirical_p(stat.where("k < 0").drop("k"), stat.where("k >= 0"), PATH)
    return surrogates.bh_fdr(tests, PATH, SIDE, c.alpha)


def estimate(source: DataFrame, target: DataFrame, found: DataFrame, screened: DataFrame, c: RunConfig) -> DataFrame:
    """(pathway, b, dr2, posterior): time courses of the pathways that passed the screen, from their found channels only."""
    live = found.select(*PAIR).join(screened.where("significant").select(*PATH), PATH, "left_semi")
    chosen = source.join(live, [*SIDE, "src", "src_channel"])
    same = F.col("src") == F.col("tgt") if c.matched else F.lit(False)
    own = [f"ar{k}" for k in range(1, c.ar_order + 1)]
    at = [*SIDE, "tgt", "tgt_channel", "b"]

    wide, names, _ = by_channel(chosen.where(~same), channels_of(source), c, [*PATH, "tgt_channel"])
    rows = wide.join(target, at)
    if c.moderator is not None:
        mean = target.where(F.col("tgt") == c.moderator).groupBy(*SIDE, "b").agg(F.avg("y").alias("moderator"))
        rows = stage2.moderators(rows, mean, SIDE, "moderator")
        rows = rows.withColumns({f"m_{x}": F.col(x) * F.col("moderator") for x in names})
        names = names + [f"m_{x}" for x in names]
    fits = regression.ewls(rows, [*PATH, "tgt_channel"], names, own, "y", c.gamma, c.ridge, c.min_n)
    series = fits.groupBy(*PATH, "b").agg(F.avg(F.nanvl("dr2", F.lit(None).cast("double"))).alias("dr2"))
    if c.detector == "hmm":
        series = series.join(states.hmm_posterior(series, PATH, "dr2", c.rate), [*PATH, "b"], "left")
    else:
        series = series.withColumn("posterior", (F.round("dr2", 9) > c.min_dr2).cast("double"))
    if c.matched:
        rows = chosen.where(same).join(target.select(*at, "y", "valid"), at)
        post, noise = switching.switching(rows, PATH, "tgt_channel", "y", columns(c), c.ar_order, valid="valid")
        less = noise.groupBy(*PATH).agg(F.avg(F.greatest(1 - F.col("sigma2_1") / F.greatest("sigma2_0", F.lit(1e-8)), F.lit(0.0))).alias("dr2"))
        series = series.select(*PATH, "b", "dr2", "posterior").union(post.join(less, PATH).select(*PATH, "b", "dr2", "posterior"))
    return series.select(*PATH, "b", "dr2", "posterior")


def decide(source: DataFrame, target: DataFrame, screened: DataFrame, series: DataFrame, c: RunConfig) -> DataFrame:
    """(pathway, found, p_adjusted, mean_dr2, fraction, significant) of every pathway that could be tested.

    Pathways whose source is in ``both_ways``, made of both people's streams, must add variance.
    """
    every = source.select(*SIDE, "src").distinct().join(target.select(*SIDE, "tgt").distinct(), SIDE)
    tested = stage2.decisions(series, screened, PATH, -c.min_dr2, c.cut, c.min_fraction)
    floor = F.when(F.col("src").isin(list(c.both_ways)), 0.0).otherwise(-c.min_dr2)
    out = every.join(tested, PATH, "left").withColumn("found", F.col("p_adjusted").isNotNull())
    return out.select(*PATH, "found", "p_adjusted", "mean_dr2", "fraction", (F.coalesce("significant", F.lit(False)) & (F.coalesce("mean_dr2", F.lit(0.0)) >= floor)).alias("significant"))


def analyze_both(samples: DataFrame, path: str, config: RunConfig = RunConfig()) -> dict[str, DataFrame]:
    """The ``results.TABLES`` of a run over all sessions, read back from ``path``.

    ``samples`` (session_id, participant, modality, channel, t, x). Stages that the folder has for the same
    parameters aren't made again: their names carry a hash of the parameters, not of the samples, so other samples
    need another folder. Sessions with one person have no pathways.
    """
    spark, c = samples.sparkSession, config
    mark = hashlib.sha256(json.dumps(asdict(c), sort_keys=True).encode()).hexdigest()[:16]
    stage: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, make: results.cached(spark, f"{path}/_stages/{mark}/{name}", make)
    z = stage("signals", lambda: signals(samples, c))
    source, target = stage("source", lambda: leading(z, c)), stage("target", lambda: led(z, c))
    found = stage("found", lambda: discover(source, target, c))
    screened = stage("screened", lambda: screen(source, target, found, c))
    series = stage("series", lambda: estimate(source, target, found, screened, c))
    decided = stage("decided", lambda: decide(source, target, screened, series, c))
    meta = decided.groupBy(*SIDE).agg(F.count("*").alias("n_pathways"), F.sum(F.col("significant").cast("int")).alias("n_significant"), F.lit(mark).alias("config"))
    tables = {"pathways": decided, "series": series, "discovery": found, "meta": meta}
    for name, df in tables.items():
        results.save_all(df, path, name)
    return {name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}
