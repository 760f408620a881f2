"""Broadcasts behind a counted bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows that are broadcast at most.
MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is; counting stops beyond them."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
