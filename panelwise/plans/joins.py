"""Joins whose keys may be NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``<=>``: a NULL key meets a NULL key.  The result has the key columns once."""
    other = right.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    out = left.join(other, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_key_{k}" for k in keys])
