"""Sources: sampled streams and markers as tall tables, and the session store.

Samples are (modality, participant, user_id, t, x) with t in seconds since ``EPOCH``; markers are
(session_id, t, label). A session store is Parquet partitioned by session and modality, so that a
query for one modality reads only its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
BIN_S = 21600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', {ts})") / F.lit(1e6)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as samples; even users are participant p1."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", F.col("event_type").alias("modality"), F.when(F.col("user_id") % 2 == 0, "p1").otherwise("p2").alias("participant"),
        seconds("ts").alias("t"), F.col("value").alias("x"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition markers by user: a sign-up starts an interval, a purchase stops it."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    label = F.when(F.col("event_type") == "signup", "active_start").otherwise("active_stop")
    return events.select(F.col("user_id").alias("session_id"), seconds("ts").alias("t"), label.alias("label"))


def write_session_store(samples_: DataFrame, path: str) -> None:
    """One folder for each session and modality."""
    samples_.write.mode("overwrite").partitionBy("session_id", "modality").parquet(path)


def read_session_store(spark: SparkSession, path: str, sessions: list[str] | None = None, modalities: list[str] | None = None) -> DataFrame:
    """The store, or some sessions and modalities of it: partition filters, other files stay unread."""
    out = spark.read.parquet(path)
    if sessions is not None:
        out = out.where(F.col("session_id").isin(sessions))
    return out if modalities is None else out.where(F.col("modality").isin(modalities))


def latest_versions(catalog: DataFrame) -> DataFrame:
    """Of a listing (name, path, mtime), the latest path of each name; equal times by path."""
    return catalog.groupBy("name").agg(F.max(F.struct("mtime", "path")).alias("m")).select("name", "m.path", "m.mtime")


def detect_roles(streams: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, role): 'patient' where any stream's text has ``pattern`` without regard to case, else 'therapist'."""
    hit = F.max(F.instr(F.lower(F.coalesce(F.col(text), F.lit(""))), pattern.lower()) > 0)
    return streams.groupBy(key).agg(F.when(hit, "patient").otherwise("therapist").alias("role"))
