"""Feature-stage queries (WIN1-9, AGG10) on the event panel P1."""

from __future__ import annotations

from ..operators import features as fe
from ..plans.segments import hot_entities
from ..sources.tables import EVENT_SPEC, SHIP_SPEC, event_panel, ship_panel
from . import register
from .common import E, MEASURES, P1, P2, TS, rounded, sql_frame, sql_r6, sql_w

WINDOWS = (7, 14, 30)
SQL_STAT = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}


def _features(spark, sf_dir, groups):
    p = event_panel(spark, sf_dir).select(E, "timestamp", *MEASURES)
    out = fe.add_features(p, EVENT_SPEC, groups)
    names = [c for c in out.columns if c not in p.columns]
    return rounded(out.select(E, "timestamp", *names), names)


def _sql(select_exprs: list[str], extra_cte: str = "", source: str = "p") -> str:
    return f"{P1}{extra_cte} SELECT {E}, {TS}, " + ", ".join(select_exprs) + f" FROM {source}"


def _rolling_sql(stat: str) -> str:
    return _sql([f"{sql_r6(f'coalesce({SQL_STAT[stat]}({m}) {sql_frame(w)}, 0)')} AS {m}_{stat}_{w}d"
                 for m in MEASURES for w in WINDOWS])


for _stat in ("mean", "max", "min", "std"):
    def _q(spark, sf_dir, _s=_stat):
        return _features(spark, sf_dir, [fe.rolling((_s,), WINDOWS)])
    register(f"rolling_{_stat}", _rolling_sql(_stat))(_q)


@register("delta", _sql([f"{sql_r6(f'coalesce({m} - lag({m}, {w}) {sql_w()}, 0)')} AS {m}_delta_{w}d"
                         for m in MEASURES for w in WINDOWS]))
def delta(spark, sf_dir):
    return _features(spark, sf_dir, [fe.deltas(WINDOWS)])


@register("lag_features", _sql([f"{sql_r6(f'coalesce(lag({m}, {k}) {sql_w()}, 0)')} AS {m}_lag_{k}d"
                                for m in MEASURES for k in (1, 3, 7)]))
def lag_features(spark, sf_dir):
    return _features(spark, sf_dir, [fe.lags((1, 3, 7))])


@register("trend_2pt", _sql([f"{sql_r6(f'coalesce(({m} - lag({m}, {s}) {sql_w()}) / {s}.0, 0)')} "
                             f"AS {m}_trend_{s}d" for m in MEASURES for s in (7, 14)]))
def trend_2pt(spark, sf_dir):
    return _features(spark, sf_dir, [fe.trends((7, 14))])


_SLOPE_CTE = f", r AS (SELECT *, CAST(row_number() {sql_w()} AS DOUBLE) AS rn FROM p)"


@register("trend_slope", _sql(
    [f"{sql_r6(f'CASE WHEN count({m}) {sql_frame(7)} >= 3 THEN coalesce(regr_slope({m}, rn) {sql_frame(7)}, 0) ELSE 0 END')}"
     f" AS {m}_slope_7d" for m in MEASURES], _SLOPE_CTE, "r"))
def trend_slope(spark, sf_dir):
    return _features(spark, sf_dir, [fe.slope(7, 3)])


_THR_CTE = (", t AS (SELECT " + E + ", " + ", ".join(f"quantile_cont({m}, 0.9) AS thr_{m}" for m in MEASURES)
            + f" FROM p GROUP BY {E}), j AS (SELECT p.*, " + ", ".join(f"thr_{m}" for m in MEASURES)
            + f" FROM p LEFT JOIN t USING ({E}))")


@register("spike_count", _sql(
    [f"CASE WHEN count(*) {sql_frame(w)} >= {w} THEN CAST(sum(CASE WHEN {m} > thr_{m} THEN 1 ELSE 0 END) "
     f"{sql_frame(w)} AS DOUBLE) ELSE 0.0 END AS {m}_spike_{w}d" for m in MEASURES for w in WINDOWS],
    _THR_CTE, "j"))
def spike_count(spark, sf_dir):
    return _features(spark, sf_dir, [fe.spikes(WINDOWS, 0.9)])


_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(\"timestamp\" AS DATE)) AS INTEGER)"


@register("rolling_days", _sql(
    [f"{sql_r6(f'coalesce(avg({m}) OVER (PARTITION BY {E} ORDER BY {_DAY} RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 0)')}"
     f" AS {m}_mean_{w}days" for m in MEASURES for w in (7, 14)]))
def rolling_days(spark, sf_dir):
    return _features(spark, sf_dir, [fe.rolling_days(("mean",), (7, 14))])


@register("quantile_by_entity", f"{P1} SELECT {E}, " + ", ".join(
    f"{sql_r6(f'quantile_cont({m}, 0.9)')} AS {m}_p90" for m in MEASURES) + f" FROM p GROUP BY {E}")
def quantile_by_entity(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    out = fe.entity_thresholds(p, EVENT_SPEC, list(MEASURES), 0.9, hot_entities(p, EVENT_SPEC),
                               names={m: f"{m}_p90" for m in MEASURES})
    return rounded(out)


def full_feature_sql(panel_cte: str, measures: list[str]) -> str:
    """DuckDB text of the whole feature stage (every family of ``default_groups``)."""
    thr = (", t AS (SELECT " + E + ", " + ", ".join(f"quantile_cont({m}, 0.9) AS thr_{m}" for m in measures)
           + f" FROM p GROUP BY {E}), j AS (SELECT p.*, " + ", ".join(f"thr_{m}" for m in measures)
           + f", CAST(row_number() {sql_w()} AS DOUBLE) AS rn FROM p LEFT JOIN t USING ({E}))")
    cols = []
    for m in measures:
        for w in WINDOWS:
            for s in ("mean", "max", "min", "std"):
                cols.append(f"{sql_r6(f'coalesce({SQL_STAT[s]}({m}) {sql_frame(w)}, 0)')} AS {m}_{s}_{w}d")
            cols.append(f"{sql_r6(f'coalesce({m} - lag({m}, {w}) {sql_w()}, 0)')} AS {m}_delta_{w}d")
        cols += [f"{sql_r6(f'coalesce(lag({m}, {k}) {sql_w()}, 0)')} AS {m}_lag_{k}d" for k in (1, 3, 7)]
        cols += [f"{sql_r6(f'coalesce(({m} - lag({m}, {s}) {sql_w()}) / {s}.0, 0)')} AS {m}_trend_{s}d" for s in (7, 14)]
        cols += [f"CASE WHEN count(*) {sql_frame(w)} >= {w} THEN CAST(sum(CASE WHEN {m} > thr_{m} THEN 1 ELSE 0 END) "
                 f"{sql_frame(w)} AS DOUBLE) ELSE 0.0 END AS {m}_spike_{w}d" for w in WINDOWS]
        slope = f"CASE WHEN count({m}) {sql_frame(7)} >= 3 THEN coalesce(regr_slope({m}, rn) {sql_frame(7)}, 0) ELSE 0 END"
        cols.append(f"{sql_r6(slope)} AS {m}_slope_7d")
    return f"{panel_cte}{thr} SELECT {E}, {TS}, " + ", ".join(cols) + " FROM j"


@register("feature_table", full_feature_sql(P1, list(MEASURES)))
def feature_table(spark, sf_dir):
    """Full feature stage on P1 (all families, one exchange)."""
    return _features(spark, sf_dir, fe.default_groups(EVENT_SPEC))


_SHIP = ["m_qty", "m_disc", "m_price"]


@register("ship_features", full_feature_sql(P2, _SHIP))
def ship_features(spark, sf_dir):
    """Bench headline: every feature family for the three shipment measures of P2."""
    p = ship_panel(spark, sf_dir).select(E, "timestamp", *_SHIP)
    out = fe.add_features(p, SHIP_SPEC, fe.default_groups(SHIP_SPEC))
    names = [c for c in out.columns if c not in p.columns]
    return rounded(out.select(E, "timestamp", *names), names)
