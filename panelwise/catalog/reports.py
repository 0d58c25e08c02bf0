"""Report and export queries (WIN13, EXP1-4, AGG5-7, AGG12-14, SRT4-5, PRJ4, PRJ12-13, ML22)
and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import band
from ..operators import features as fe
from ..operators import report as rp
from ..operators import score as sc
from ..sources.tables import EVENT_SPEC, SHIP_SPEC, event_panel, ship_panel, table
from ..spec import catalogue, feature_names
from . import register
from .common import E, MEASURES, P1, P2, TS, rounded, sql_frame, sql_r6, sql_w
from .scoring import P3, scored

_LATEST = f"QUALIFY row_number() OVER (PARTITION BY {E} ORDER BY {TS} DESC) = 1"

_FLAG = (f"{P1}, f AS (SELECT {E}, {TS}, m_value, n_events, "
         f"coalesce(avg(m_value) {sql_frame(7)}, 0) AS m_value_mean_7d, "
         f"coalesce(m_value - lag(m_value, 7) {sql_w()}, 0) AS m_value_delta_7d, "
         f"coalesce(lag(m_value, 1) {sql_w()}, 0) AS m_value_lag_1d FROM p), "
         f"l AS (SELECT * FROM f {_LATEST}), "
         f"s AS (SELECT *, 1.0 / (1.0 + exp(-(CAST(-3.0 AS DOUBLE) + CAST(0.02 AS DOUBLE) * m_value "
         f"+ CAST(0.7 AS DOUBLE) * n_events))) AS pr FROM l) "
         f"SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value, {sql_r6('m_value_mean_7d')} AS m_value_mean_7d, "
         f"{sql_r6('m_value_delta_7d')} AS m_value_delta_7d, {sql_r6('m_value_lag_1d')} AS m_value_lag_1d, "
         f"{sql_r6('pr')} AS failure_probability, "
         f"CASE WHEN pr > 0.7 THEN 'high' WHEN pr > 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM s")


@register("flagship", _FLAG)
def flagship(spark, sf_dir):
    """events -> daily panel -> 7-row mean, 7-row delta, lag 1 -> latest row per entity -> risk band."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value", "n_events")
    f = fe.add_features(p, EVENT_SPEC, [fe.rolling(("mean",), (7,)), fe.deltas((7,)), fe.lags((1,))],
                        measures=["m_value"])
    last = rp.latest(f, EVENT_SPEC)
    s = last.withColumn("failure_probability", sc.fixed_logistic(-3.0, {"m_value": 0.02, "n_events": 0.7}))
    s = s.withColumn("risk_level", band("failure_probability"))
    return rounded(s.select(E, "timestamp", "m_value", "m_value_mean_7d", "m_value_delta_7d", "m_value_lag_1d",
                            "failure_probability", "risk_level"))


@register("latest_per_entity", f"{P1} SELECT {E}, {TS}, " + ", ".join(f"{sql_r6(m)} AS {m}" for m in MEASURES)
          + f", n_events, failure FROM p {_LATEST}")
def latest_per_entity(spark, sf_dir):
    return rounded(rp.latest(event_panel(spark, sf_dir), EVENT_SPEC))


@register("labeled_latest", f"{P2} SELECT {E}, {TS}, failure, {sql_r6('m_qty')} AS m_qty, "
          f"{sql_r6('m_price')} AS m_price FROM p {_LATEST}")
def labeled_latest(spark, sf_dir):
    p = ship_panel(spark, sf_dir).select(E, "timestamp", "failure", "m_qty", "m_price")
    return rounded(rp.latest(p, SHIP_SPEC))


@register("label_counts", f"{P1} SELECT failure, count(*) AS n FROM p GROUP BY 1")
def label_counts(spark, sf_dir):
    return rp.label_counts(event_panel(spark, sf_dir))


@register("class_weights", f"{P1}, c AS (SELECT failure, count(*) AS n FROM p GROUP BY 1) "
          f"SELECT failure, n, {sql_r6('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)')} AS class_weight FROM c")
def class_weights(spark, sf_dir):
    return rounded(rp.class_weights(event_panel(spark, sf_dir)))


@register("failure_rate", f"{P1} SELECT {sql_r6('avg(CAST(failure AS DOUBLE)) * 100')} AS failure_rate FROM p")
def failure_rate(spark, sf_dir):
    return rounded(rp.failure_rate(event_panel(spark, sf_dir)))


# the riskiest entity: most failure days, then smallest id (derived from the whole table)
_PICK = f"k AS (SELECT {E} FROM p GROUP BY 1 ORDER BY sum(failure) DESC, {E} LIMIT 1)"


def _riskiest(p):
    return (p.groupBy(E).agg(F.sum("failure").alias("_f")).orderBy(F.col("_f").desc(), F.col(E))
            .limit(1).select(E).scalar())


@register("entity_series", f"{P1}, {_PICK} SELECT {E}, {TS}, " + ", ".join(f"{sql_r6(m)} AS {m}" for m in MEASURES)
          + f", failure FROM p WHERE {E} = (SELECT {E} FROM k)")
def entity_series(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    return rounded(rp.entity_series(p, EVENT_SPEC, _riskiest(p)).select(E, "timestamp", *MEASURES, "failure"))


@register("trend_series", f"{P1}, {_PICK} SELECT {TS}, {sql_r6('m_value')} AS m_value FROM p "
          f"WHERE {E} = (SELECT {E} FROM k)")
def trend_series(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    return rounded(rp.entity_series(p, EVENT_SPEC, _riskiest(p), ["m_value"]).select("timestamp", "m_value"))


_LATEST_SCORED = P3 + f", l AS (SELECT * FROM b {_LATEST}) "


@register("fleet_summary", _LATEST_SCORED + f"SELECT count(DISTINCT {E}) AS total_disks, "
          "count(*) FILTER (WHERE risk_level = 'low') AS healthy, count(*) FILTER (WHERE risk_level = 'medium') AS warning, "
          f"count(*) FILTER (WHERE risk_level = 'high') AS critical, {sql_r6('avg(CAST(failure AS DOUBLE)) * 100')} AS failure_rate FROM l")
def fleet_summary(spark, sf_dir):
    return rounded(rp.fleet_summary(rp.latest(scored(spark, sf_dir), EVENT_SPEC), EVENT_SPEC))


@register("risk_by_date", P3 + f"SELECT CAST({TS} AS DATE) AS date, count(*) AS \"rows\", count(*) FILTER (WHERE failure = 1) AS failures, "
          "count(*) FILTER (WHERE risk_level IN ('medium', 'high')) AS warnings FROM b GROUP BY 1")
def risk_by_date(spark, sf_dir):
    return rp.risk_by_date(scored(spark, sf_dir), EVENT_SPEC)


@register("risk_distribution", P3 + "SELECT risk_level, count(*) AS n FROM b GROUP BY 1")
def risk_distribution(spark, sf_dir):
    return rp.risk_distribution(scored(spark, sf_dir))


@register("top_risk", _LATEST_SCORED + f"SELECT {E}, {TS}, {sql_r6('failure_probability')} AS failure_probability, risk_level "
          f"FROM l ORDER BY failure_probability DESC, {E} LIMIT 10")
def top_risk(spark, sf_dir):
    last = rp.latest(scored(spark, sf_dir), EVENT_SPEC)
    return rounded(rp.top_n(last, "failure_probability", 10, [E])
                   .select(E, "timestamp", "failure_probability", "risk_level"))


@register("mask_entity", f"{P1} SELECT sha256(concat('panel-salt', {E})) AS {E}, {TS}, {sql_r6('m_value')} AS m_value FROM p")
def mask_entity(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value")
    return rounded(rp.masked(p, EVENT_SPEC, "panel-salt"))


@register("feature_partitions", f"{P2} SELECT CAST(year({TS}) AS INTEGER) AS year, CAST(month({TS}) AS INTEGER) AS month, "
          "count(*) AS \"rows\" FROM p GROUP BY 1, 2")
def feature_partitions(spark, sf_dir):
    p = rp.with_partitions(ship_panel(spark, sf_dir), SHIP_SPEC)
    return p.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))


@register("expirable_partitions", f"{P2}, a AS (SELECT max(l_shipdate) AS as_of FROM lineitem) "
          f"SELECT CAST(year({TS}) AS INTEGER) AS year, CAST(month({TS}) AS INTEGER) AS month, count(*) AS \"rows\", "
          f"max(CAST({TS} AS DATE)) AS last_day, max(CAST({TS} AS DATE)) < CAST((SELECT as_of FROM a) AS DATE) - INTERVAL 6 MONTH "
          "AS expirable FROM p GROUP BY 1, 2")
def expirable_partitions(spark, sf_dir):
    as_of = table(spark, sf_dir, "lineitem").select(F.max("l_shipdate")).scalar()
    return rp.expirable_partitions(ship_panel(spark, sf_dir), SHIP_SPEC, as_of, 6)


_SLOPE = (f"{P1}, r AS (SELECT *, CAST(row_number() {sql_w()} AS DOUBLE) AS rn FROM p), "
          f"f AS (SELECT {E}, {TS}, m_value, CASE WHEN count(m_value) {sql_frame(7)} >= 3 THEN "
          f"coalesce(regr_slope(m_value, rn) {sql_frame(7)}, 0) ELSE 0 END AS sl FROM r), l AS (SELECT * FROM f {_LATEST}) ")


@register("days_to_limit", _SLOPE + f"SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value, {sql_r6('sl')} AS m_value_slope_7d, "
          "CASE WHEN sl > 0 AND m_value < 40.0 THEN CAST(ceil((40.0 - m_value) / sl) AS BIGINT) END AS days_to_failure, "
          f"CASE WHEN sl > 0 AND m_value < 40.0 THEN CAST(CAST({TS} AS DATE) + CAST(ceil((40.0 - m_value) / sl) AS INTEGER) AS DATE) END "
          "AS predicted_failure_date FROM l")
def days_to_limit(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value")
    f = fe.add_features(p, EVENT_SPEC, [fe.slope(7, 3)], measures=["m_value"])
    last = rp.latest(f, EVENT_SPEC)
    d = sc.days_to_limit(F.col("m_value"), F.col("m_value_slope_7d"), 40.0)
    out = last.select(E, "timestamp", "m_value", "m_value_slope_7d", d.alias("days_to_failure"),
                      F.date_add(F.to_date("timestamp"), d.cast("int")).alias("predicted_failure_date"))
    return rounded(out, ["m_value", "m_value_slope_7d"])


def _catalogue_sql() -> str:
    from .features import full_feature_sql
    inner = full_feature_sql(P1, list(MEASURES)).replace(f"SELECT {E}, {TS}, ", f"SELECT {E}, {TS}, "
                                                         + ", ".join(MEASURES) + ", ", 1)
    names = feature_names(EVENT_SPEC, list(MEASURES))
    cat = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1))
    return (f"WITH f AS ({inner}), u AS (UNPIVOT f ON COLUMNS(* EXCLUDE ({E}, {TS})) INTO NAME feature VALUE v), "
            f"m AS (SELECT feature, avg(v) AS mean_value FROM u GROUP BY feature), "
            f"c AS (SELECT CAST(o AS INTEGER) AS ordinal, n AS feature FROM (VALUES {cat}) t(o, n)) "
            f"SELECT c.ordinal, c.feature, {sql_r6('m.mean_value')} AS mean_value FROM c LEFT JOIN m USING (feature)")


@register("feature_catalogue", _catalogue_sql())
def feature_catalogue(spark, sf_dir):
    """SRC8: the feature catalogue of P1 with each feature's mean over the full feature table."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", *MEASURES)
    f = fe.add_features(p, EVENT_SPEC, fe.default_groups(EVENT_SPEC))
    names = [c for c in f.columns if c not in p.columns]
    f = rounded(f, names)
    cols = [c for c in f.columns if c not in (E, "timestamp")]
    long = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                        for c in cols])).alias("s")).select("s.*")
    means = long.groupBy("feature").agg(F.avg("v").alias("mean_value"))
    cat = catalogue(spark, EVENT_SPEC, EVENT_SPEC.present(p))  # one row per feature name
    return rounded(cat.join(F.broadcast(means), "feature", "left").select("ordinal", "feature", "mean_value"))


@register("model_monitoring", P3 + f"SELECT CAST({TS} AS DATE) AS date, count(*) AS scored, count(failure) AS labelled, "
          f"{sql_r6('avg(CASE WHEN failure IS NOT NULL THEN CAST(failure = prediction AS DOUBLE) END)')} AS accuracy, "
          "count(*) FILTER (WHERE failure = 1) AS actual_positive, count(*) FILTER (WHERE prediction = 1) AS predicted_positive, "
          f"{sql_r6('avg(failure_probability)')} AS mean_probability FROM b GROUP BY 1")
def model_monitoring(spark, sf_dir):
    return rounded(rp.monitoring(scored(spark, sf_dir), EVENT_SPEC))


@register("preview", f"{P1} SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value, n_events, failure FROM p "
          f"ORDER BY {E}, {TS} LIMIT 5")
def preview(spark, sf_dir):
    """SRT6: the first five rows in (entity, time) order (a top-k, not a full sort)."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value", "n_events", "failure")
    return rounded(p.orderBy(E, "timestamp").limit(5))


@register("latest_refresh", f"{P1} SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value, failure FROM p {_LATEST}")
def latest_refresh(spark, sf_dir):
    """EXP5: latest table of all days but the last three, refreshed with those three days;
    equals the latest row over everything."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value", "failure")
    cut = p.select(F.max("timestamp") - F.expr("INTERVAL 2 DAYS")).scalar()
    old = rp.latest(p.filter(F.col("timestamp") < cut), EVENT_SPEC)
    return rounded(rp.refresh_latest(old, p.filter(F.col("timestamp") >= cut), EVENT_SPEC))


@register("global_time_order", f"{P1} SELECT {TS}, count(*) AS \"rows\", count(DISTINCT {E}) AS entities FROM p GROUP BY 1 ORDER BY 1")
def global_time_order(spark, sf_dir):
    """SRT2/AGG11: per-day volume in global time order."""
    p = event_panel(spark, sf_dir)
    return p.groupBy("timestamp").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(E).alias("entities")).orderBy("timestamp")
