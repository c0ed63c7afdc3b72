"""Memory of tasks: small Arrow batches, and caches that one operator leaves behind in a worker.

Spark's Python workers serve one task after another, so what an operator remembers for its next task
would stay while quite another one runs.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch; texts are long, so Spark's default of 10,000 would be tens of megabytes on both sides.
BATCH_ROWS = 1000
_LEFT: dict[str, Callable[[], None]] = {}


def modest_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of the session have ``BATCH_ROWS`` rows at most, unless it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Notes, in a task, that ``operator`` keeps something in this worker, and how to drop it."""
    _LEFT[operator] = forget


def only(operator: str) -> None:
    """Drops, at the start of a task, what operators other than this one keep in this worker."""
    for other in [x for x in _LEFT if x != operator]:
        _LEFT.pop(other)()
    given_back()


def given_back() -> None:
    """Hands freed memory back to the system: an idle worker's counts against its executor as much as a busy one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
