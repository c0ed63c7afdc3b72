"""Long streams in spans: windows that need some rows around them, and running values that need all before.

A span is a range of ``b`` (or of time). Rows near a border are copied into the neighbouring span as its
halo, or what a span adds up to is carried into the later ones, so no task orders a whole stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a span of the grid.
SPAN = 4096


def haloed(rows: DataFrame, before: float, after: float, size: float = SPAN, at: str = "b") -> DataFrame:
    """``rows`` with their span ``_span``, again for each other span whose rows reach them, and ``_own``.

    A row of a span looks back by ``before`` and ahead by ``after`` at most.
    """
    place = lambda shift: F.floor((F.col(at) + shift) / size)
    near = F.sequence(place(-after), place(before))
    out = rows.withColumn("_span", F.explode(near))
    return out.withColumn("_own", F.col("_span") == place(0))


def own(rows: DataFrame) -> DataFrame:
    """The rows of ``haloed`` that belong to their span."""
    return rows.where("_own").drop("_span", "_own")


def lag_sums(rows: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, Mapping[int, float]], size: int = SPAN) -> DataFrame:
    """``rows`` with columns: name -> sum of weight * value of the row ``lag`` earlier (later if negative).

    ``b`` has no gaps; what lies outside the stream counts as 0.
    """
    lags = sorted({k for w in weights.values() for k in w})
    by = Window.partitionBy(*keys, "_span").orderBy("b")
    spread = haloed(rows, max(0, *lags), max(0, *(-k for k in lags)), size)
    spread = spread.withColumns({f"_v{i}": F.coalesce(F.lag(value, k).over(by) if k > 0 else F.lead(value, -k).over(by) if k else F.col(value), F.lit(0.0)) for i, k in enumerate(lags)})
    columns = {name: sum((F.col(f"_v{lags.index(k)}") * F.lit(float(v)) for k, v in w.items()), F.lit(0.0)) for name, w in weights.items()}
    return own(spread.withColumns(columns)).drop(*[f"_v{i}" for i in range(len(lags))])


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, Column]], size: float = SPAN, at: str = "b", inclusive: bool = True, later: bool = False) -> DataFrame:
    """``rows`` with running columns: name -> (``sum``, ``max`` or ``min``, of what) over all rows up to each.

    Rows are ordered by ``order``, which begins with ``at``; ``later`` takes the rows after. Of each span
    one row is carried over to the others.
    """
    kind = {"sum": F.sum, "max": F.max, "min": F.min}
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    turned = [F.desc(c) if later else F.asc(c) for c in order]
    rows = rows.withColumn("_span", F.floor(F.col(at) / size))
    inside = Window.partitionBy(*keys, "_span").orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = Window.partitionBy(*keys).orderBy(F.desc("_span") if later else F.asc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_span").agg(*[kind[k](c).alias(name) for name, (k, c) in columns.items()])
    carried = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_span").alias("_at"), *[kind[k](name).over(over).alias(f"_c_{name}") for name, (k, _) in columns.items()])
    same = F.col("_span") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumns({name: kind[k](c).over(inside) for name, (k, c) in columns.items()}).join(carried, same)
    out = out.withColumns({name: both[k](F.col(name), F.col(f"_c_{name}")) for name, (k, _) in columns.items()})
    return out.drop("_span", "_at", *[f"_k{i}" for i in range(len(keys))], *[f"_c_{name}" for name in columns])
