"""Connected components of a link table, by repeated minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm._shared import dropped, written


#: Labels up to this many (16 bytes each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_LABELS = 1_000_000


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label's own label.
    Minima are taken before the shuffle, and a node with very many links has one row of labels to be
    joined with, so Spark splits its side where it is skewed; every round is written to the shared folder
    in place of the one before. Nulls link nothing, repeated links and loops are harmless. The result is
    a table of ``written`` with its number of rows as ``n_rows``.
    """
    one_way = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.union(both.select("a", F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    n = labels.count()
    near = F.broadcast if n <= MAX_BROADCAST_LABELS else lambda df: df
    while True:
        its = near(labels.select(F.col("node").alias("b"), "component"))
        low = edges.join(its, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"), F.min(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was"))
        jump = near(labels.select(F.col("node").alias("low"), F.col("component").alias("next")))
        after = written(low.join(jump, "low", "left").select("node", F.least("low", "next").alias("component"), "was"))
        changed = after.where("component <> was").limit(1).count()
        dropped(labels)
        labels = after.select("node", "component")
        labels.written_at, labels.n_rows = after.written_at, n
        if not changed:
            dropped(edges)
            return labels
