"""Recursions over long streams in chunks, where no product of matrices would do.

Each chunk begins with a guess of the state at its border, found by a run through the rows beyond it. A chunk
whose guess isn't what its neighbour ends with is run again from there, until all borders agree. Every
turn sets at least one more chunk of a stream right for good, so it ends, and the result is that of one pass;
filters forget, so one or two turns are what it takes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.sources.shared import dropped, written

#: Rows of a chunk, and rows beyond it that it runs through to find a start.
CHUNK, RUN_IN = 4096, 256
#: States agree if no number differs by more than this, for sizes over 1 relatively.
AGREE = 1e-9


def kinds(rows: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)


def columns(schema: str) -> list[str]:
    return [x.strip().split()[0].strip("`") for x in schema.split(",")]


def of(streams: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``streams`` (keys, low, high, ...) once for each of their chunks ``_span``."""
    return streams.withColumn("_span", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))


def agreed(chunks: DataFrame, keys: Sequence[str], run: Callable[[DataFrame], DataFrame], later: bool = False) -> DataFrame:
    """A written table of ``run`` with one row a chunk, all of whose borders agree.

    ``run`` takes (keys, _span, start) and returns those with ``end`` and more; a null start is a guess of
    its own, of which it returns the state at the border. ``start`` and ``end`` are arrays of doubles; with
    ``later`` a chunk starts from the end of the chunk after it.
    """
    by = [*keys, "_span"]
    far = F.aggregate(F.zip_with("start", "given", lambda x, g: F.abs(x - g) / F.greatest(F.abs(g), F.lit(1.0))), F.lit(0.0), lambda s, v: F.greatest(s, v))
    done = written(run(chunks.select(*by, F.lit(None).cast("array<double>").alias("start"))))
    while True:
        given = done.select(*keys, (F.col("_span") + (-1 if later else 1)).alias("_span"), F.col("end").alias("given"))
        differ = F.when(F.size("start") == F.size("given"), far > AGREE).otherwise(True)
        wrong = written(done.select(*by, "start").join(given, by).where(differ).select(*by, F.col("given").alias("start")))
        if not wrong.limit(1).count():
            dropped(wrong)
            return done
        after = written(done.join(wrong.select(*by), by, "left_anti").union(run(wrong).select(*done.columns)))
        dropped(done, wrong)
        done = after
