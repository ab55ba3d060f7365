"""Choices that rest on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000


def small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``max_rows`` rows, else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
