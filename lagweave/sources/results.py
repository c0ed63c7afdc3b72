"""Where results live: decisions, time courses and discoveries of runs, as Parquet by session and direction."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a run.
TABLES = ("pathways", "series", "discovery", "meta")


def pathway_key(src: str = "src", tgt: str = "tgt"):
    """One string for a pathway."""
    return F.concat_ws("||", src, tgt)


def save_result(tables: Mapping[str, DataFrame], path: str, session: str, direction: str) -> None:
    """Writes the ``TABLES`` of one run; a run of the same session and direction is replaced, others stay."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"{name} is none of {TABLES}")
        df.write.mode("overwrite").parquet(f"{path}/{name}/session_id={session}/direction={direction}")


def save_all(df: DataFrame, path: str, name: str) -> None:
    """Writes one of the ``TABLES`` of many runs (session_id, direction, ...): those that are in it are replaced, others stay."""
    if name not in TABLES:
        raise ValueError(f"{name} is none of {TABLES}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "direction").parquet(f"{path}/{name}")


def load_result(spark: SparkSession, path: str, name: str, session: str | None = None, direction: str | None = None) -> DataFrame:
    """A table of all runs, or of some: partition filters, other files stay unread."""
    out = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/session_id=*/direction=*")
    out = out if session is None else out.where(F.col("session_id") == session)
    return out if direction is None else out.where(F.col("direction") == direction)


def load_direction(spark: SparkSession, path: str, direction: str) -> DataFrame:
    """(session_id, src, tgt, significant, mean_dr2) of one direction, means taken again from the time courses."""
    mean = load_result(spark, path, "series", direction=direction).groupBy("session_id", "src", "tgt").agg(F.avg("dr2").alias("mean_dr2"))
    return load_result(spark, path, "pathways", direction=direction).select("session_id", "src", "tgt", "significant").join(mean, ["session_id", "src", "tgt"], "left")


def pathway_features(found: DataFrame, src: str, tgt: str) -> DataFrame:
    """(feature, mean_dr2) of one pathway, the largest first."""
    return found.where((F.col("src") == src) & (F.col("tgt") == tgt)).orderBy(F.desc("mean_dr2"), "feature").select("feature", "mean_dr2")


def find_sessions(catalog: DataFrame, part: str) -> DataFrame:
    """The rows of a listing whose name contains ``part``; the first by name is the session meant."""
    return catalog.where(F.col("name").contains(part)).orderBy("name")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there: a cache read through."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ensure_all(spark: SparkSession, path: str, makers: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables by name, errors by name): each session's table at ``path``/name, made where it is missing.

    One that can't be made doesn't keep the others from it; what it had begun to write isn't taken for done.
    """
    done, failed = {}, {}
    for name, make in makers.items():
        try:
            done[name] = cached(spark, f"{path}/{name}", make)
        except Exception as e:  # of whatever kind: it is reported
            failed[name] = f"{type(e).__name__}: {e}"[:500]
    return done, failed


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not there yet, by key."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def with_features(stored: DataFrame, path: str, features: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """The named feature tables of a store, each made from it and kept at ``path`` where it is missing."""
    return {name: cached(stored.sparkSession, f"{path}/{name}", lambda make=make: make(stored)) for name, make in features.items()}
