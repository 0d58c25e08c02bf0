"""Driver tables and the panels derived from them (FIXTURES P1, P2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import PanelSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# P1: daily event panel (nullable measures, ~27 days per entity)
EVENT_SPEC = PanelSpec(measures=("m_value", "m_purchase", "m_error"))
# P2: daily shipment panel (long history per supplier)
SHIP_SPEC = PanelSpec(measures=("m_qty", "m_disc", "m_price"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, day) of ``events``: mean value, purchase sum, error mean, count,
    and ``failure`` = at least two errors that day."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    is_purchase = F.col("event_type") == "purchase"
    is_error = F.col("event_type") == "error"
    return (ev.groupBy(F.col("user_id").cast("string").alias("serial_number"),
                       F.to_date("ts").cast("timestamp_ntz").alias("timestamp"))
            .agg(F.avg("value").alias("m_value"),
                 F.sum(F.when(is_purchase, F.col("value"))).alias("m_purchase"),
                 F.avg(F.when(is_error, F.col("value"))).alias("m_error"),
                 F.count(F.lit(1)).alias("n_events"),
                 (F.count_if(is_error) >= 2).cast("int").alias("failure")))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (supplier, ship day) of ``lineitem``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag")
    return (li.groupBy(F.col("l_suppkey").alias("serial_number"),
                       F.col("l_shipdate").alias("timestamp"))
            .agg(F.sum("l_quantity").alias("m_qty"),
                 F.avg("l_discount").alias("m_disc"),
                 F.sum("l_extendedprice").alias("m_price"),
                 F.max((F.col("l_returnflag") == "R").cast("int")).alias("failure")))


# SQL text of the same panels, for the DuckDB oracle.
EVENT_PANEL_SQL = """
SELECT CAST(user_id AS VARCHAR) AS serial_number,
       date_trunc('day', ts) AS "timestamp",
       avg(value) AS m_value,
       sum(value) FILTER (WHERE event_type = 'purchase') AS m_purchase,
       avg(value) FILTER (WHERE event_type = 'error') AS m_error,
       count(*) AS n_events,
       CAST(count(*) FILTER (WHERE event_type = 'error') >= 2 AS INTEGER) AS failure
FROM events GROUP BY 1, 2
"""

SHIP_PANEL_SQL = """
SELECT l_suppkey AS serial_number, l_shipdate AS "timestamp",
       sum(l_quantity) AS m_qty, avg(l_discount) AS m_disc, sum(l_extendedprice) AS m_price,
       max(CAST(l_returnflag = 'R' AS INTEGER)) AS failure
FROM lineitem GROUP BY 1, 2
"""
