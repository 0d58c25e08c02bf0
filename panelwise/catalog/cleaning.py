"""Cleaning queries (IMP1, WIN10-12, OUT1-2) on the event panel P1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean
from ..operators import features as fe
from ..plans.feature_job import build_features
from ..sources.tables import EVENT_SPEC, event_panel
from . import register
from .common import E, MEASURES, P1, TS, rounded, sql_r6

_COLS = list(MEASURES)
_UNB = f"OVER (PARTITION BY {E} ORDER BY {TS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FOL = f"OVER (PARTITION BY {E} ORDER BY {TS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _panel(spark, sf_dir):
    return event_panel(spark, sf_dir).select(E, "timestamp", *_COLS)


def _scan_cte() -> str:
    cols = []
    for m in _COLS:
        t = f"CASE WHEN {m} IS NOT NULL THEN epoch({TS}) END"
        cols += [f"last_value({m} IGNORE NULLS) {_UNB} AS pv_{m}", f"last_value({t} IGNORE NULLS) {_UNB} AS pt_{m}",
                 f"first_value({m} IGNORE NULLS) {_FOL} AS nv_{m}", f"first_value({t} IGNORE NULLS) {_FOL} AS nt_{m}"]
    return f"{P1}, s AS (SELECT {E}, {TS}, {', '.join(_COLS)}, epoch({TS}) AS t, {', '.join(cols)} FROM p) "


def _fill_sql(interp: bool, ffill: bool, bfill: bool, zero: bool) -> str:
    outs = []
    for m in _COLS:
        parts = [m]
        if interp:
            parts.append(f"CASE WHEN pv_{m} IS NOT NULL AND nv_{m} IS NOT NULL THEN "
                         f"pv_{m} + (nv_{m} - pv_{m}) * (t - pt_{m}) / (nt_{m} - pt_{m}) END")
        if ffill:
            parts.append(f"pv_{m}")
        if bfill:
            parts.append(f"nv_{m}")
        if zero:
            parts.append("0.0")
        outs.append(f"{sql_r6('coalesce(' + ', '.join(parts) + ')')} AS {m}")
    return _scan_cte() + f"SELECT {E}, {TS}, {', '.join(outs)} FROM s"


@register("ffill", _fill_sql(False, True, False, False))
def ffill(spark, sf_dir):
    return rounded(clean.forward_fill(_panel(spark, sf_dir), EVENT_SPEC))


@register("bfill", _fill_sql(False, False, True, False))
def bfill(spark, sf_dir):
    return rounded(clean.backward_fill(_panel(spark, sf_dir), EVENT_SPEC))


@register("interpolate", _fill_sql(True, False, False, False))
def interpolate(spark, sf_dir):
    return rounded(clean.interpolate(_panel(spark, sf_dir), EVENT_SPEC))


@register("impute_chain", _fill_sql(True, True, True, True))
def impute_chain(spark, sf_dir):
    return rounded(clean.impute(_panel(spark, sf_dir), EVENT_SPEC))


_B = ", ".join(f"coalesce(avg({c}), 0) - 3.0 * coalesce(stddev_samp({c}), 0) AS lo_{c}, "
               f"coalesce(avg({c}), 0) + 3.0 * coalesce(stddev_samp({c}), 0) AS hi_{c}" for c in _COLS)
_BCTE = f"{P1}, b AS (SELECT {_B} FROM p) "


@register("clip_3sigma", _BCTE + f"SELECT {E}, {TS}, " + ", ".join(
    f"{sql_r6(f'CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, lo_{c}), hi_{c}) END')} AS {c}"
    for c in _COLS) + " FROM p, b")
def clip_3sigma(spark, sf_dir):
    return rounded(clean.clip_outliers(_panel(spark, sf_dir), _COLS))


@register("log1p_measure", f"{P1} SELECT {E}, {TS}, " + ", ".join(
    f"{sql_r6(f'CASE WHEN {c} > -1 THEN ln(1 + {c}) END')} AS {c}" for c in _COLS) + " FROM p")
def log1p_measure(spark, sf_dir):
    return rounded(clean.log_transform(_panel(spark, sf_dir), _COLS))


@register("remove_outliers", _BCTE + f"SELECT {E}, {TS}, " + ", ".join(f"{sql_r6(c)} AS {c}" for c in _COLS)
          + " FROM p, b WHERE " + " AND ".join(f"({c} IS NULL OR {c} BETWEEN lo_{c} AND hi_{c})" for c in _COLS))
def remove_outliers(spark, sf_dir):
    return rounded(clean.remove_outliers(_panel(spark, sf_dir), _COLS))


def _pipeline_sql() -> str:
    """PIP1 stated in SQL: impute, clip to training bounds, window features, z-score of training rows."""
    fill = [f"coalesce({m}, CASE WHEN pv_{m} IS NOT NULL AND nv_{m} IS NOT NULL THEN pv_{m} + (nv_{m} - pv_{m}) * (t - pt_{m}) "
            f"/ (nt_{m} - pt_{m}) END, pv_{m}, nv_{m}, 0.0) AS {m}" for m in _COLS]
    bound = [f"{a}({c}) AS {n}_{c}" for c in _COLS for a, n in (("avg", "mu"), ("stddev_samp", "sd"))]
    clip = [f"least(greatest({c}, mu_{c} - 3.0 * sd_{c}), mu_{c} + 3.0 * sd_{c}) AS {c}" for c in _COLS]
    w, w7 = f"(PARTITION BY {E} ORDER BY {TS})", f"(PARTITION BY {E} ORDER BY {TS} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    feats = [x for c in _COLS for x in (
        f"coalesce(avg({c}) OVER {w7}, 0) AS {c}_mean_7d", f"coalesce(max({c}) OVER {w7}, 0) AS {c}_max_7d",
        f"coalesce({c} - lag({c}, 7) OVER {w}, 0) AS {c}_delta_7d", f"coalesce(lag({c}, 1) OVER {w}, 0) AS {c}_lag_1d")]
    names = [n for c in _COLS for n in (c, f"{c}_mean_7d", f"{c}_max_7d", f"{c}_delta_7d", f"{c}_lag_1d")]
    stats = [f"avg({n}) AS mu_{n}, CASE WHEN coalesce(stddev_samp({n}), 0) = 0 THEN 1.0 ELSE stddev_samp({n}) END AS sd_{n}" for n in names]
    scaled = [f"{sql_r6(f'({n} - mu_{n}) / sd_{n}')} AS {n}_scaled" for n in names]
    return (f"{_scan_cte()}, k AS (SELECT max({TS}) - INTERVAL 7 DAY AS cut FROM p), i AS (SELECT {E}, {TS}, {', '.join(fill)} FROM s), "
            f"b AS (SELECT {', '.join(bound)} FROM i, k WHERE {TS} < cut), c AS (SELECT {E}, {TS}, {', '.join(clip)} FROM i, b), "
            f"f AS (SELECT *, {', '.join(feats)} FROM c), z AS (SELECT {', '.join(stats)} FROM f, k WHERE {TS} < cut) "
            f"SELECT {E}, {TS}, {', '.join(scaled)} FROM f, z")


@register("feature_pipeline", _pipeline_sql())
def feature_pipeline(spark, sf_dir):
    """PIP1: the whole feature stage; clip bounds and scaling fitted on all but the last week."""
    p = _panel(spark, sf_dir)
    cut = p.agg(F.max("timestamp") - F.expr("INTERVAL 7 DAYS")).scalar()
    groups = [fe.rolling(("mean", "max"), (7,)), fe.deltas((7,)), fe.lags((1,))]
    res = build_features(p, EVENT_SPEC, groups=groups, scale_method="zscore", fit_on=F.col("timestamp") < cut)
    return rounded(res.features)

