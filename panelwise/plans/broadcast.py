"""Broadcast only what has a checked size; otherwise leave the join to the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest row count we hand to ``broadcast()`` after counting.
MAX_BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Broadcast ``df`` when it has at most ``max_rows`` rows.

    The count runs on the (small, already aggregated) side only.  Above the bound
    the frame is returned as is and Spark plans a shuffle join, with AQE free to
    switch strategy at run time from real sizes.
    """
    n = df.limit(max_rows + 1).count()
    return (F.broadcast(df) if n <= max_rows else df), n


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast hint for a frame that is a global aggregate (exactly one row)."""
    return F.broadcast(df)
