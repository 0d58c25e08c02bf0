"""Quality-check queries (AGG2-4, AGG15-18) on the event panel P1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qa
from ..sources.tables import EVENT_PANEL_SQL, EVENT_SPEC, event_panel, table
from . import register
from .common import E, MEASURES, P1, TS, rounded, sql_r6

EVENT_PANEL_SQL_CTE = f"p AS ({EVENT_PANEL_SQL})"

_COLS = list(MEASURES)


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _missing_sql(key_cols=()) -> str:
    parts = []
    for c in _COLS:
        limit = 0.01 if c in key_cols else 0.05
        miss = f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))"
        rate = f"CASE WHEN count(*) > 0 THEN {miss} / count(*) ELSE 0.0 END"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", {miss} AS missing, "
                     f"{sql_r6(rate)} AS missing_rate, ({rate}) > {limit} AS breach FROM p")
    return f"{P1} " + _union(parts)


@register("missing_rate", _missing_sql())
def missing_rate(spark, sf_dir):
    return rounded(qa.missing_rate(event_panel(spark, sf_dir), _COLS))


@register("key_quality", _missing_sql(("m_value",)))
def key_quality(spark, sf_dir):
    return rounded(qa.missing_rate(event_panel(spark, sf_dir), _COLS, key_cols=("m_value",)))


def _moments_sql(c: str) -> tuple[str, str]:
    return f"coalesce(avg({c}), 0)", f"coalesce(stddev_samp({c}), 0)"


_BOUNDS = _union([f"SELECT '{c}' AS \"column\", {_moments_sql(c)[0]} AS mean, {_moments_sql(c)[1]} AS std FROM p"
                  for c in _COLS])


@register("outlier_bounds", f"{P1}, b AS ({_BOUNDS}) SELECT \"column\", {sql_r6('mean')} AS mean, "
          f"{sql_r6('std')} AS std, {sql_r6('mean - 3.0 * std')} AS lower, {sql_r6('mean + 3.0 * std')} AS upper FROM b")
def outlier_bounds(spark, sf_dir):
    return rounded(qa.outlier_bounds(event_panel(spark, sf_dir), _COLS))


def _outlier_rate_sql() -> str:
    parts = []
    for c in _COLS:
        lo = f"(SELECT mean - 3.0 * std FROM b WHERE \"column\" = '{c}')"
        hi = f"(SELECT mean + 3.0 * std FROM b WHERE \"column\" = '{c}')"
        n_out = f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi})"
        rate = f"CASE WHEN count(*) > 0 THEN {n_out} / count(*) ELSE 0.0 END"
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", {n_out} AS outliers, "
                     f"{sql_r6(rate)} AS outlier_rate, ({rate}) > 0.01 AS breach FROM p")
    return f"{P1}, b AS ({_BOUNDS}) " + _union(parts)


@register("outlier_rate", _outlier_rate_sql())
def outlier_rate(spark, sf_dir):
    return rounded(qa.outlier_rate(event_panel(spark, sf_dir), _COLS))


_DAYNO = f"date_diff('day', DATE '1970-01-01', CAST({TS} AS DATE))"


@register("continuity", f"{P1} SELECT {E}, min(CAST({TS} AS DATE)) AS first_day, "
          f"max(CAST({TS} AS DATE)) AS last_day, count(DISTINCT {_DAYNO}) AS days_present, "
          f"CAST(max({_DAYNO}) - min({_DAYNO}) + 1 AS BIGINT) AS days_expected, "
          f"CAST(max({_DAYNO}) - min({_DAYNO}) + 1 - count(DISTINCT {_DAYNO}) AS BIGINT) AS days_missing "
          f"FROM p GROUP BY {E}")
def continuity(spark, sf_dir):
    return qa.continuity(event_panel(spark, sf_dir), EVENT_SPEC)


@register("gap_list", f"{P1}, d AS (SELECT DISTINCT {E}, {_DAYNO} AS dn FROM p), "
          f"l AS (SELECT {E}, dn, lag(dn) OVER (PARTITION BY {E} ORDER BY dn) AS prev FROM d) "
          f"SELECT {E}, CAST(DATE '1970-01-01' + CAST(prev + 1 AS INTEGER) AS DATE) AS gap_start, "
          f"CAST(dn - prev - 1 AS BIGINT) AS gap_days FROM l WHERE dn - prev > 1")
def gap_list(spark, sf_dir):
    return qa.gaps(event_panel(spark, sf_dir), EVENT_SPEC)


@register("freshness", f"{P1}, a AS (SELECT max(ts) AS as_of FROM events) "
          f"SELECT {E}, max({TS}) AS last_ts, "
          f"CAST(date_diff('day', CAST(max({TS}) AS DATE), CAST((SELECT as_of FROM a) AS DATE)) AS BIGINT) AS days_since, "
          f"date_diff('day', CAST(max({TS}) AS DATE), CAST((SELECT as_of FROM a) AS DATE)) > 1 AS stale "
          f"FROM p GROUP BY {E}")
def freshness(spark, sf_dir):
    as_of = table(spark, sf_dir, "events").select(F.max("ts")).scalar()
    out = qa.freshness(event_panel(spark, sf_dir), EVENT_SPEC, as_of)
    return out.withColumn("days_since", F.col("days_since").cast("long"))


_RANGES = {"m_value": (0.0, 50.0), "m_purchase": (0.0, 150.0), "m_error": (0.0, 50.0)}


@register("value_range", f"{P1} " + _union([
    f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) "
    f"AS out_of_range FROM p" for c, (lo, hi) in _RANGES.items()]))
def value_range(spark, sf_dir):
    return qa.value_range(event_panel(spark, sf_dir), _RANGES)


@register("row_count", f"{P1} SELECT count(*) AS \"rows\", count(DISTINCT {E}) AS entities FROM p")
def row_count(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(E).alias("entities"))


_AUDIT = ("WITH a AS (SELECT CAST(user_id AS VARCHAR) AS serial_number, date_trunc('day', ts) AS \"timestamp\", "
          "CAST(count(*) FILTER (WHERE event_type = 'error') >= 2 AS INTEGER) AS audited FROM events GROUP BY 1, 2), "
          + EVENT_PANEL_SQL_CTE + " SELECT count(*) AS audited_rows, "
          + sql_r6("avg(CAST(p.failure = a.audited AS DOUBLE))") + " AS label_accuracy FROM p JOIN a USING (serial_number, \"timestamp\")")


@register("label_audit", _AUDIT)
def label_audit(spark, sf_dir):
    """AGG19: panel labels against labels recomputed from the raw events (error events
    per user and day), joined on (entity, day)."""
    ev = table(spark, sf_dir, "events")
    audit = (ev.groupBy(F.col("user_id").cast("string").alias(E),
                        F.to_date("ts").cast("timestamp_ntz").alias("timestamp"))
             .agg((F.count_if(F.col("event_type") == "error") >= 2).cast("int").alias("audited")))
    out = qa.label_accuracy(event_panel(spark, sf_dir), audit, [E, "timestamp"], "failure", "audited")
    return rounded(out)
