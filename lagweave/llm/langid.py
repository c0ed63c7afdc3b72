"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams are hashed into a fixed number of buckets. Document frequencies are
counted over all training documents on the cluster; the classifier is fitted with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled documents,
then one temperature is set on the part of the sample that was not fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.llm._split import remainder

BITS = 15
BUCKETS = 1 << BITS
_PART = 1 << 20
_ODD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]
_LETTERS = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's character n-grams (n = 1 to 3) occur in the whole text.

    Lower-cased; everything but letters counts as a space. Long texts are read in overlapping
    parts, so each n-gram counts once and memory stays bounded.
    """
    out = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(text), _PART):
        codes = np.frombuffer(text[low : low + _PART + 2].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letters = _LETTERS[np.minimum(codes, 0xFFFF)]
        for k in np.flatnonzero(codes > 0xFFFF).tolist():
            letters[k] = chr(codes[k]).isalpha()
        codes = np.where(letters, codes, 32).astype(np.uint32)
        mixed = np.zeros(0, np.uint32)
        last = low + _PART >= len(text)
        for n, odd in enumerate(_ODD):
            here = codes * odd
            here ^= here >> np.uint32(15)
            here = here * _ODD[0] + np.uint32(n)
            mixed = here if n == 0 else (mixed[:-1] * _ODD[2]) ^ here[n:]
            starts = mixed if last else mixed[:_PART]
            out += np.bincount((starts * _ODD[1]) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Fitted weights; ``langs`` empty means that nothing could be learned."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at]) * self.idf[at]
        return at, values / max(float(np.sqrt(values @ values)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        at, values = self.vector(gram_counts(text))
        p = softmax(values @ self.weights[at] / self.temperature)
        return self.langs[int(np.argmax(p))], float(min(1.0, p.max()))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal with per-coordinate steps; l1 and l2 are the elastic-net penalties."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def solved(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, values, y = examples[k]
            zz, nn = z[at], n[at]
            w = solved(zz, nn)
            p = softmax(values @ w)
            p[y] -= 1.0
            g = values[:, None] * p[None, :]
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / alpha * w
            n[at] = more
    return solved(z, n)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, on a fixed grid from 0.02 to 5."""
    grid = np.geomspace(0.02, 5.0, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Documents, and documents that have each bucket, over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                if text := cell.as_py():
                    total[:BUCKETS] += gram_counts(text) > 0
                total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return int(df[BUCKETS]), df[:BUCKETS]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> Model:
    """Fit on the rows of ``docs`` that have a language.

    The classifier sees at most ``per_lang`` documents of each language, those with the smallest
    hashes of their id and text (whole texts); document frequencies cover all rows. Null or letterless
    texts are left out; no usable row gives a model that answers 'und'.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and id is not null")
    mark = F.xxhash64("id", "text").alias("mark")
    by_hash = Window.partitionBy("lang").orderBy("mark")
    drawn = F.broadcast(known.where("text is not null").select("lang", mark).distinct().withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_lang).select("mark").distinct())
    total, df = document_frequencies(known, "text")
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    c = gram_counts(text)
                    at = np.flatnonzero(c)
                    rows.append((lang, at.tolist(), c[at].tolist()))
            langs, ats, counts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ats, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "at", "n"])

    sample = known.withColumn("mark", mark).join(drawn, "mark", "left_semi").dropDuplicates(["mark", "lang"]).select("text", "lang").mapInArrow(vectors, "lang string, at array<int>, n array<int>").collect()  # per_lang texts a language
    sample.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    blank = Model(langs, idf, np.zeros((BUCKETS, len(langs))), 1.0)
    examples = []
    for r in sample:
        counts = np.zeros(BUCKETS, np.int64)
        counts[r["at"]] = r["n"]
        examples.append((*blank.vector(counts), langs.index(r["lang"])))
    held = [e for k, e in enumerate(examples) if k % 5 == 4] or examples
    weights = ftrl([e for k, e in enumerate(examples) if k % 5 != 4] or examples, len(langs))
    logits = np.array([v @ weights[at] for at, v, _ in held])
    return Model(langs, idf, weights, temperature(logits, np.array([y for *_, y in held])))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: whole texts, one by one, without a shuffle.

    A null text, or one without a letter, is 'und' with score 0. Rows with equal or null ids are
    kept as they are; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(cell.as_py()) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder() != 0))
    return identify(docs, model).select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score")
