"""The fixed split of documents into those learned from and those held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(id_col: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts
