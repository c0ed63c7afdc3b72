"""Toxicity by maximum-scoring segments.

Words and word beginnings get log-odds of the toxic against the clean class with an informative
Dirichlet prior, counted over a bounded sample of labelled training documents. A linear-time scan finds every
maximal-scoring run of words; scores become E-values by extreme-value theory, and one rising
curve on training documents that took no part in the counts turns them into probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm._memory import modest_batches, only
from lagweave.llm._shared import dropped, written
from lagweave.llm._split import remainder

TOKEN = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)
#: A word's score falls by this for each word, so that chance hits far apart don't add up.
DRIFT = 0.15
HEAD = min(STEMS)
_FLUSH = 50_000
#: Evidence is -ln E; a passage is significant from E = 0.05. Steps of ``STEP`` for calibration.
SIGNIFICANT, FLOOR, CEILING, STEP = 3.0, -12.0, 60.0, 0.5


def segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last position, score), in one pass.

    ``positions`` rise and have positive ``scores``; every position between them scores -``drift``.
    This is the Ruzzo-Tompa scan with the runs of negative positions taken in one step.
    """
    done: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the nearest with less before
    total, last = 0.0, None
    for p, s in zip(positions, scores):
        total -= drift * (p - last - 1) if last is not None else 0.0
        new = (p, p, total, total + s)
        total, last = total + s, p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0:  # no later segment can join one that starts higher
                done += [(a, b, after - before) for a, b, before, after, _ in found]
                found = [(*new, -1)]
                break
            if found[j][3] >= new[3]:
                found.append((*new, j))
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return done + [(a, b, after - before) for a, b, before, after, _ in found]


def lowered(text: str) -> str:
    """Lower case with as many code points, so that places are those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Model:
    """``weights``, ``stems``: log-odds. ``knots``, ``shares``: the calibration curve."""

    weights: dict[str, float]
    stems: dict[str, float]
    lam: float = 1.0
    k: float = 0.1
    knots: list[float] = field(default_factory=lambda: [0.0])
    shares: list[float] = field(default_factory=lambda: [0.01])
    drift: float = DRIFT
    heads: set[str] = field(init=False)
    kept: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.heads = {w[:HEAD] for w in (*self.weights, *self.stems)}  # few words begin like this

    def word_score(self, word: str) -> float:
        if (s := self.kept.get(word)) is None:
            stems = (self.stems.get(word[:n], 0.0) for n in reversed(STEMS) if len(word) > n)
            s = self.weights.get(word) or next(filter(None, stems), 0.0)
            if len(self.kept) > _FLUSH:
                self.kept.clear()
            self.kept[word] = s
        return s

    def best(self, text: str | None) -> tuple[float, int]:
        """(score of the best passage, 0 if there is none; words)."""
        tokens = TOKEN.findall(lowered(text)) if text else []
        rated = [(i, s) for i, w in enumerate(tokens) if w[:HEAD] in self.heads and (s := self.word_score(w))]
        return max((s for *_, s in segments([i for i, _ in rated], [s for _, s in rated], self.drift)), default=0.0), len(tokens)

    def scan(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], list[str]]:
        """(evidence, passages as first and last token and E-value, tokens)."""
        tokens = TOKEN.findall(lowered(text)) if text else []
        heads = self.heads
        rated = [(i, s) for i, w in enumerate(tokens) if w[:HEAD] in heads and (s := self.word_score(w))]
        if not rated:
            return FLOOR, [], tokens
        base = math.log(self.k * max(len(tokens), 1))
        found = [(a, b, self.lam * s - base) for a, b, s in segments([i for i, _ in rated], [s for _, s in rated], self.drift)]
        best = max(x for *_, x in found)
        passages = [(a, b, x) for a, b, x in found if x >= SIGNIFICANT]
        evidence = sum(x for *_, x in passages) if passages else best
        return max(FLOOR, min(CEILING, evidence)), [(a, b, math.exp(-x)) for a, b, x in passages], tokens

    def probability(self, evidence: float) -> float:
        return float(np.interp(evidence, self.knots, self.shares))


def class_counts(labelled: DataFrame) -> DataFrame:
    """(token, toxic, clean): documents of each class that have each word, or word beginning (with a tab).

    The token of one line end has the numbers of words of each class.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        length = [0, 0]
        only("toxicity")

        def out() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["token", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                tokens = TOKEN.findall(lowered(text.as_py() or ""))
                words = set(tokens)
                length[1 if y.as_py() else 0] += len(tokens)
                seen[1 if y.as_py() else 0].update(words | {f"{w[:n]}\t" for w in words for n in STEMS if len(w) > n})  # a tab marks stems
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield out()
        seen[0]["\n"], seen[1]["\n"] = length
        yield out()

    return labelled.select("text", "toxic").mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _karlin(pos: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1, p being shares of clean words."""
    hit = sum(p for p, _ in pos)

    def total(lam: float) -> float:
        return sum(p * math.exp(min(60.0, lam * s)) for p, s in pos) + (1 - hit) * math.exp(-lam * drift) - 1

    low, high = 1e-3, 8.0
    if total(high) < 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", prior: float = 0.1, z_min: float = 3.0, max_rows: int = 30_000) -> Model:
    """Fit on the labelled rows of ``docs`` (id, text) that have a row with a label in ``labels``.

    At most ``max_rows`` labelled ids take part, those with the smallest hashes, so the labels can be
    broadcast and no text is shuffled. Documents with crc32(id) mod 10 of 8 or 9 set the curve, the others the log-odds. The model
    keeps all words and stems with z >= ``z_min``. lambda solves the equation of Karlin and Altschul for
    the clean class, K is the likeliest for its best passages. Null labels are left out, a null text is
    empty; without labelled rows every score is the same low one.
    """
    modest_batches(docs.sparkSession)
    truth = labels.select(F.col(id_col).alias("id"), F.col("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = truth.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    known = docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(sample), "id")
    tenth = remainder("id", 10)
    counted = known.where(tenth < 8)
    counts = class_counts(counted)
    sizes = {int(r["toxic"] != 0): r["n"] for r in counted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1 or not n0:
        return Model({}, {}, shares=[0.01 if not n1 else 0.99])
    both = F.col("toxic") + F.col("clean")
    a = prior * both
    y1, y0 = F.col("toxic") + a, F.col("clean") + a
    delta = F.log(y1 / ((1 + prior) * (n1 + 1) - y1 + prior * n0)) - F.log(y0 / ((1 + prior) * (n0 + 1) - y0 + prior * n1))
    sd = F.sqrt(1 / y1 + 1 / y0)
    counts = table = written(counts)
    lengths = {int(k): r[k] for r in counts.where(F.col("token") == "\n").selectExpr("toxic as `1`", "clean as `0`").collect() for k in ("0", "1")}
    counts = counts.where(F.col("token") != "\n")
    kept = counts.withColumns({"delta": delta, "sd": sd}).where(F.col("delta") >= z_min * F.col("sd")).orderBy("token").collect()  # words of the bounded sample
    dropped(table)
    weights, stems, clean_rate = {}, {}, []
    for r in kept:
        s = r["delta"] - 2 * r["sd"]  # a low estimate, above 0 as z_min is over 2
        (stems if r["token"].endswith("\t") else weights)[r["token"].rstrip("\t")] = s
        if not r["token"].endswith("\t"):
            clean_rate.append(((r["clean"] + prior) / max(lengths.get(0, 0), n0), s))
    model = Model(weights, stems, lam=_karlin(clean_rate, DRIFT))

    first = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(documents with a passage, sum of words * exp(-lambda * best score)), one row a task."""
        hit, total = 0, 0.0
        for batch in batches:
            for t in batch.column(0):
                s, n = first.value.best(t.as_py())
                hit, total = hit + (s > 0), total + n * math.exp(-first.value.lam * s)
        yield pa.RecordBatch.from_arrays([pa.array([hit], pa.int64()), pa.array([total], pa.float64())], names=["hit", "total"])

    hit, total = known.where((tenth >= 8) & (F.col("toxic") == 0)).select("text").mapInArrow(best, "hit long, total double").agg(F.sum("hit"), F.sum("total")).first()
    model.k = min(1.0, max(1e-4, (hit or 0) / total)) if total else model.k
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [round(shared.value.scan(t.as_py())[0] / STEP) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), batch.column(1).cast(pa.int32())], names=["bin", "toxic"])

    bins = known.where(tenth >= 8).select("text", "toxic").mapInArrow(evidence, "bin int, toxic int").groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect()  # a few hundred rows
    x = np.array([r["bin"] * STEP for r in bins], float)
    y = np.array([r["toxic"] != 0 for r in bins], float)
    w = np.array([r["n"] for r in bins], float)
    model.knots, model.shares = isotonic(x, y, w)
    return model


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Rising shares of label 1 by pooling adjacent violators: knots at the pools' mean evidence.

    One row of either class is added far outside, so that every share lies between 0 and 1.
    """
    pools: list[list[float]] = []  # sum of x, of toxic rows, of rows
    rows = sorted(zip(x.tolist(), y.tolist(), w.tolist()))
    for at, label, n in [(FLOOR, 0.0, 1.0), *rows, (CEILING, 1.0, 1.0)]:
        pools.append([at * n, label * n, n])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [p[0] / p[2] for p in pools], [(p[1] + 0.01) / (p[2] + 0.02) for p in pools]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_tokens, passages) for every row of ``docs``, without a shuffle.

    ``passages``: the significant toxic passages as code-point spans with E-values. Null and empty
    texts have no passage and the score of no evidence. Equal and null ids stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many numbers as words of a bounded sample
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evalue", pa.float64())]))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        m = shared.value
        for batch in batches:
            probs, sizes, spans = [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                ev, found, tokens = m.scan(text)
                probs.append(m.probability(ev))
                sizes.append(len(tokens))
                at = [x.span() for x in TOKEN.finditer(lowered(text))] if found else []
                spans.append([{"start": at[a][0], "end": at[b][1], "evalue": e} for a, b, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probs, pa.float64()), pa.array(sizes, pa.int64()), pa.array(spans, passage)], names=[id_col, "score", "n_tokens", "passages"])

    return docs.select(id_col, text_col).mapInArrow(rate, f"`{id_col}` {kind}, score double, n_tokens long, passages array<struct<start:int,end:int,evalue:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``cut``, all columns as they are, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.probability(m.scan(t.as_py())[0]) < cut for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of rows with crc32(doc_id) mod 5 not 0 and score all rows."""
    model = fit(docs.where(remainder() != 0), labels.where(remainder() != 0))
    return score(docs, model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document with its significant passages counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = train_and_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
