"""Scoring and evaluation queries on fixed scores over P1 (FIXTURES P3)."""

from __future__ import annotations

from ..operators import evaluate as ev
from ..operators import score as sc
from ..sources.tables import event_panel
from . import register
from .common import E, P1, TS, rounded, sql_r6

# The P3 fixed score p = 1 / (1 + exp(-(-3.0 + 0.02 m_value + 0.7 n_events))).
P3_INTERCEPT, P3_WEIGHTS = -3.0, {"m_value": 0.02, "n_events": 0.7}

P3 = (f"{P1}, s AS (SELECT *, 1.0 / (1.0 + exp(-(CAST(-3.0 AS DOUBLE) + CAST(0.02 AS DOUBLE) * m_value "
      f"+ CAST(0.7 AS DOUBLE) * n_events))) AS failure_probability FROM p), "
      f"b AS (SELECT *, CAST(failure_probability > 0.5 AS INTEGER) AS prediction, "
      f"CASE WHEN failure_probability > 0.7 THEN 'high' WHEN failure_probability > 0.4 THEN 'medium' "
      f"ELSE 'low' END AS risk_level FROM s) ")


def scored(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    p = p.withColumn("failure_probability", sc.fixed_logistic(P3_INTERCEPT, P3_WEIGHTS))
    return sc.with_risk(p)


@register("risk_band", P3 + f"SELECT {E}, {TS}, {sql_r6('failure_probability')} AS failure_probability, "
          "prediction, risk_level FROM b")
def risk_band(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select(E, "timestamp", "failure_probability", "prediction", "risk_level"))


@register("risk_summary", P3 + "SELECT count(*) AS total, count(*) FILTER (WHERE failure_probability > 0.7) AS high, "
          "count(*) FILTER (WHERE failure_probability > 0.4 AND failure_probability <= 0.7) AS medium, "
          "count(*) FILTER (WHERE failure_probability <= 0.4) AS low FROM b")
def risk_summary(spark, sf_dir):
    return sc.risk_summary(scored(spark, sf_dir))


@register("confusion", P3 + "SELECT failure AS actual, prediction AS predicted, count(*) AS n FROM b GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return ev.confusion(scored(spark, sf_dir))


_M = ("WITH_C AS (SELECT count(*) FILTER (WHERE failure = 1 AND prediction = 1) AS tp, "
      "count(*) FILTER (WHERE failure = 0 AND prediction = 1) AS fp, "
      "count(*) FILTER (WHERE failure = 1 AND prediction = 0) AS fn, "
      "count(*) FILTER (WHERE failure = 0 AND prediction = 0) AS tn FROM b)")


def _div(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


_P1_, _R1 = _div("tp", "tp + fp"), _div("tp", "tp + fn")
_P0, _R0 = _div("tn", "tn + fn"), _div("tn", "tn + fp")


@register("eval_metrics", P3 + ", " + _M.replace("WITH_C", "c") +
          f", m AS (SELECT *, {_P1_} AS pr1, {_R1} AS rc1, {_P0} AS pr0, {_R0} AS rc0 FROM c), "
          f"f AS (SELECT *, {_div('2 * pr1 * rc1', 'pr1 + rc1')} AS f1, {_div('2 * pr0 * rc0', 'pr0 + rc0')} AS f0 FROM m) "
          f"SELECT tp, fp, fn, tn, {sql_r6(_div('tp + tn', 'tp + fp + fn + tn'))} AS accuracy, {sql_r6('pr1')} AS precision, "
          f"{sql_r6('rc1')} AS recall, {sql_r6('f1')} AS f1_positive, "
          f"{sql_r6(_div('f1 * (tp + fn) + f0 * (tn + fp)', 'tp + fp + fn + tn'))} AS f1_weighted FROM f")
def eval_metrics(spark, sf_dir):
    return rounded(ev.metrics(scored(spark, sf_dir)))


@register("class_report", P3 + ", c AS (SELECT cls, count(*) FILTER (WHERE failure = cls AND prediction = cls) AS tp, "
          "count(*) FILTER (WHERE prediction = cls) AS predicted, count(*) FILTER (WHERE failure = cls) AS support "
          "FROM b, (VALUES (0), (1)) v(cls) GROUP BY cls), "
          f"m AS (SELECT *, {_div('tp', 'predicted')} AS precision, {_div('tp', 'support')} AS recall FROM c) "
          f"SELECT cls, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, "
          f"{sql_r6(_div('2 * precision * recall', 'precision + recall'))} AS f1, support FROM m")
def class_report(spark, sf_dir):
    return rounded(ev.class_report(scored(spark, sf_dir)))


@register("auc_rank", P3 + ", g AS (SELECT failure_probability AS sc, count(*) FILTER (WHERE failure = 1) AS pos, "
          "count(*) FILTER (WHERE failure = 0) AS neg FROM b GROUP BY 1), "
          "r AS (SELECT *, sum(neg) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM g) "
          f"SELECT {sql_r6(_div('sum(pos * (below + 0.5 * neg))', 'CAST(sum(pos) AS DOUBLE) * sum(neg)'))} AS auc FROM r")
def auc_rank(spark, sf_dir):
    return rounded(ev.auc(scored(spark, sf_dir), score="failure_probability"))


_T = ", ".join(f"({t})" for t in ev.THRESHOLDS)


@register("threshold_search", P3 + f", t AS (SELECT CAST(th AS DOUBLE) AS threshold FROM (VALUES {_T}) v(th)), "
          "c AS (SELECT threshold, count(*) FILTER (WHERE failure = 1 AND failure_probability >= threshold) AS tp, "
          "count(*) FILTER (WHERE failure = 0 AND failure_probability >= threshold) AS fp, "
          "count(*) FILTER (WHERE failure = 1 AND failure_probability < threshold) AS fn FROM b, t GROUP BY threshold), "
          f"m AS (SELECT *, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall FROM c), "
          f"f AS (SELECT *, {_div('2 * precision * recall', 'precision + recall')} AS f1 FROM m) "
          f"SELECT threshold, tp, fp, fn, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, "
          f"{sql_r6('f1')} AS f1, threshold = (SELECT min(threshold) FROM f WHERE f1 = (SELECT max(f1) FROM f)) AS best FROM f")
def threshold_search(spark, sf_dir):
    return rounded(ev.threshold_search(scored(spark, sf_dir), score="failure_probability"))


_FEATS = ["m_value", "m_purchase", "m_error", "n_events", "smart_5_raw"]


@register("align_schema", f"{P1} SELECT {E}, {TS}, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _FEATS[:-1]) + ", CAST(0.0 AS DOUBLE) AS smart_5_raw FROM p")
def align_schema(spark, sf_dir):
    return sc.align(event_panel(spark, sf_dir), _FEATS, keep=[E, "timestamp"])


@register("rule_label", f"{P1} SELECT {E}, {TS}, CAST(m_value > 25 AS INTEGER) AS rule_label FROM p")
def rule_label(spark, sf_dir):
    from ..functions.scalar import rule_label as rl
    return event_panel(spark, sf_dir).select(E, "timestamp", rl("m_value", 25.0).alias("rule_label"))


@register("risk_card", P3 + f"SELECT {E}, {TS}, risk_level, printf('%.0f%%', failure_probability * 100) AS probability_text, "
          "CASE risk_level WHEN 'high' THEN 'Back up data and replace the disk now' "
          "WHEN 'medium' THEN 'Watch closely and plan a replacement' ELSE 'Healthy, keep monitoring' END AS advice FROM b")
def risk_card(spark, sf_dir):
    return sc.card(scored(spark, sf_dir)).select(E, "timestamp", "risk_level", "probability_text", "advice")
