"""A corpus pipeline over the documents table: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import decontaminate, ngram_join, pii, sentencepiece_scan, toxicity
from lagweave.llm._shared import written
from lagweave.llm._split import remainder

#: Ids of rows to drop up to this many are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity operator rejects (score 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs.where(remainder() != 0), labels.where(remainder() != 0)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest id.

    Groups link word five-grams at a similarity of 0.8. Rows are told apart by id and text: where an id
    has several texts each is judged on its own, and of rows with the same id and text one stays. Rows
    without words stay.
    """
    groups = written(ngram_join.link_groups(docs, width=5, percent=80))
    copies = groups.where("not kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    few = copies.count() <= MAX_BROADCAST_IDS
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    kept = docs.join(F.broadcast(copies) if few else copies, same, "left_anti")
    again = groups.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= MAX_BROADCAST_IDS else again
        kept = kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that cover a benchmark item."""
    found = decontaminate.tile_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("benchmark_matches") == 0).select(*docs.columns)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the text."""
    clean = pii.redact(docs, pii.find_private(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, pieces, n_pieces, exact) of each document."""
    return sentencepiece_scan.encode(docs, sentencepiece_scan.default_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_private),
    ("sentencepiece", encode_pieces),
]

#: Trained models and byte-exact encodings are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs)
    return docs
