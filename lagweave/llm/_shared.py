"""Tables of the shared folder, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.sources.shared import dropped, shared_folder, written

__all__ = ["dropped", "salted_join", "shared_folder", "written"]

#: So many keys at most are hot, those with over this many rows; their rows are dealt to so many pieces.
HOT_KEYS, HOT_ROWS, PIECES = 1000, 200, 32


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has each ``key`` few times, so that a hot key is no hot task.

    The ``HOT_KEYS`` most frequent keys, if they have many rows, are broadcast; rows of ``many`` with such
    a key are dealt to ``PIECES`` pieces by their column ``spread``, and the row of ``one`` is copied to
    each piece. No other key has more than a ``HOT_KEYS``-th of the rows.
    """
    counts = many.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).where((F.col("_n") > HOT_ROWS) & F.col("_hot").isNotNull())
    hot = F.broadcast(counts.orderBy(F.desc("_n"), "_hot").limit(HOT_KEYS).select("_hot"))
    columns = [F.col(c) for c in many.columns]
    left = many.join(hot, many[key] == F.col("_hot"), "left").select(*columns, F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(PIECES)).cast("int") + 1).otherwise(0).alias("_piece"))
    right = one.join(hot, one[key] == F.col("_hot"), "left").select(*[one[c] for c in one.columns], F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(1), F.lit(PIECES))).otherwise(F.array(F.lit(0)))).alias("_piece"))
    return left.join(right, [key, "_piece"], how).drop("_piece")
