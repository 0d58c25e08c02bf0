"""Scaling and split queries (SCL1-3, SPL1, SPL3, SPL5, SET1) on P1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scale, split
from ..sources.tables import EVENT_SPEC, event_panel
from . import register
from .common import E, MEASURES, P1, TS, rounded, sql_r6

_COLS = list(MEASURES)


def _panel(spark, sf_dir):
    return event_panel(spark, sf_dir).select(E, "timestamp", *_COLS)


_Z = ", ".join(f"coalesce(avg({c}), 0) AS mu_{c}, CASE WHEN stddev_samp({c}) IS NULL OR stddev_samp({c}) = 0 "
               f"THEN 1.0 ELSE stddev_samp({c}) END AS sd_{c}" for c in _COLS)


@register("zscore", f"{P1}, z AS (SELECT {_Z} FROM p) SELECT {E}, {TS}, " + ", ".join(
    f"{sql_r6(f'({c} - mu_{c}) / sd_{c}')} AS {c}_scaled" for c in _COLS) + " FROM p, z")
def zscore(spark, sf_dir):
    out, _ = scale.standardize(_panel(spark, sf_dir), _COLS, "zscore")
    return rounded(out)


_R = ", ".join(f"coalesce(quantile_cont({c}, 0.5), 0) AS md_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iq_{c}"
               for c in _COLS)


@register("robust_scale", f"{P1}, q AS (SELECT {_R} FROM p) SELECT {E}, {TS}, " + ", ".join(
    f"{sql_r6(f'({c} - md_{c}) / CASE WHEN iq_{c} IS NULL OR iq_{c} <= 0 THEN 1.0 ELSE iq_{c} END')} AS {c}_scaled"
    for c in _COLS) + " FROM p, q")
def robust_scale(spark, sf_dir):
    out, _ = scale.standardize(_panel(spark, sf_dir), _COLS, "robust")
    return rounded(out)


_MM = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _COLS)


@register("minmax_scale", f"{P1}, m AS (SELECT {_MM} FROM p) SELECT {E}, {TS}, " + ", ".join(
    f"{sql_r6(f'CASE WHEN hi_{c} - lo_{c} = 0 THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END')} AS {c}_scaled"
    for c in _COLS) + " FROM p, m")
def minmax_scale(spark, sf_dir):
    out, _ = scale.standardize(_panel(spark, sf_dir), _COLS, "minmax")
    return rounded(out)


_CUT = (f"c AS (SELECT {TS} AS t, count(*) AS n FROM p GROUP BY 1), "
        "r AS (SELECT t, sum(n) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
        "sum(n) OVER () AS tot FROM c)")


@register("time_split", f"{P1}, {_CUT}, k AS (SELECT min(t) AS cutoff FROM r WHERE cum >= 0.8 * tot) "
          f"SELECT {E}, {TS}, failure, CASE WHEN {TS} <= cutoff THEN 'train' ELSE 'test' END AS split FROM p, k")
def time_split(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure")
    return split.time_split(p, EVENT_SPEC, 0.8)


_DAYNO = f"date_diff('day', DATE '1970-01-01', CAST({TS} AS DATE))"


@register("stratified_split", f"{P1}, h AS (SELECT *, md5(concat_ws('|', '42', {E}, CAST({_DAYNO} AS VARCHAR))) AS hh FROM p), "
          "r AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY hh) AS rk, count(*) OVER (PARTITION BY failure) AS nl FROM h) "
          f"SELECT {E}, {TS}, failure, CASE WHEN rk <= round(nl * 0.2) THEN 'test' ELSE 'train' END AS split FROM r")
def stratified_split(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure")
    p = p.withColumn("_dayno", F.unix_date(F.to_date("timestamp")))
    return split.stratified_split(p, "failure", [E, "_dayno"], 0.2, 42).drop("_dayno")


@register("except_split", f"{P1}, {_CUT}, k AS (SELECT min(t) AS cutoff FROM r WHERE cum >= 0.8 * tot) "
          f"SELECT {E}, {TS}, failure FROM p EXCEPT SELECT {E}, {TS}, failure FROM p, k WHERE {TS} <= cutoff")
def except_split(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure")
    s = split.time_split(p, EVENT_SPEC, 0.8)
    train = s.filter(F.col("split") == "train").drop("split")
    return split.except_split(p, train)


def _ro_sql(k: int = 3) -> str:
    cuts = ", ".join(f"(SELECT min(t) FROM r WHERE cum >= {i}.0 / {k + 1} * tot) AS c{i - 1}" for i in range(1, k + 1))
    folds = " UNION ALL ".join(
        f"SELECT {i} AS fold, c{i} AS lo, {f'c{i + 1}' if i + 1 < k else 'NULL'} AS hi FROM k" for i in range(k))
    return (f"{P1}, {_CUT}, k AS (SELECT {cuts}), b AS ({folds}) "
            f"SELECT fold, CASE WHEN {TS} < lo THEN 'train' ELSE 'test' END AS role, {E}, {TS}, failure FROM p, b "
            f"WHERE {TS} < lo OR ({TS} >= lo AND (hi IS NULL OR {TS} < hi))")


@register("rolling_origin_folds", _ro_sql(3))
def rolling_origin_folds(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure")
    return split.rolling_origin(p, EVENT_SPEC, 3)
