"""Helpers shared by the registered queries and their SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import ROUND_BELOW, r6
from ..sources.tables import EVENT_PANEL_SQL, SHIP_PANEL_SQL

E, TS = "serial_number", '"timestamp"'
MEASURES = ("m_value", "m_purchase", "m_error")
P1 = f"WITH p AS ({EVENT_PANEL_SQL})"
P2 = f"WITH p AS ({SHIP_PANEL_SQL})"


def rounded(df: DataFrame, cols=None) -> DataFrame:
    """Round every double column (or ``cols``) to 6 digits, keeping names and order."""
    doubles = {f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = set(cols) if cols is not None else doubles
    return df.select(*[r6(c).alias(c) if c in targets else F.col(c) for c in df.columns])


def sql_r6(expr: str) -> str:
    """Same formula as ``functions.scalar.r6``."""
    x = f"CAST({expr} AS DOUBLE)"
    y = f"({x} * CAST(1.0000000000001 AS DOUBLE))"
    small = f"floor({y} * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < CAST({ROUND_BELOW!r} AS DOUBLE) THEN {small} "
            f"ELSE CAST(CAST({y} AS FLOAT) AS DOUBLE) END + CAST(0.0 AS DOUBLE))")


def sql_frame(n: int, order: str = TS) -> str:
    return (f"OVER (PARTITION BY {E} ORDER BY {order} "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def sql_w(order: str = TS) -> str:
    return f"OVER (PARTITION BY {E} ORDER BY {order})"
