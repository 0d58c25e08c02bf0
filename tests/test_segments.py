"""Hot entities split into segments must give exactly the plain per-entity results."""

import pytest
from pyspark.sql import functions as F

from panelwise.operators import clean
from panelwise.operators import features as fe
from panelwise.sources.tables import EVENT_SPEC, SHIP_SPEC, event_panel, ship_panel

from .conftest import SF_SMALL


def _same(a, b, keys):
    ka = {tuple(r[k] for k in keys): r.asDict() for r in a.collect()}
    kb = {tuple(r[k] for k in keys): r.asDict() for r in b.collect()}
    assert len(ka) == a.count() and ka.keys() == kb.keys()
    for k, ra in ka.items():
        rb = kb[k]
        assert ra.keys() == rb.keys()
        for c, u in ra.items():
            v = rb[c]
            if isinstance(u, float) and isinstance(v, float):
                assert u == pytest.approx(v, rel=1e-9, abs=1e-9), (k, c)
            else:
                assert u == v, (k, c)


def test_split_features_equal_plain(spark):
    p = ship_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_qty", "m_price")
    groups = fe.default_groups(SHIP_SPEC)
    plain = fe.add_features(p, SHIP_SPEC.with_(hot_rows=None), groups, ["m_qty", "m_price"])
    # every supplier has ~500 rows: with hot_rows=40 each is cut into ~13 segments
    split = fe.add_features(p, SHIP_SPEC.with_(hot_rows=40), groups, ["m_qty", "m_price"])
    _same(plain, split, ["serial_number", "timestamp"])


def test_split_calendar_frames_equal_plain(spark):
    p = ship_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_qty")
    g = [fe.rolling_days(("mean", "max"), (10,))]
    plain = fe.add_features(p, SHIP_SPEC.with_(hot_rows=None), g, ["m_qty"])
    split = fe.add_features(p, SHIP_SPEC.with_(hot_rows=25), g, ["m_qty"])
    _same(plain, split, ["serial_number", "timestamp"])


def test_split_fills_equal_plain(spark):
    p = event_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_purchase", "m_error")
    plain = clean.impute(p, EVENT_SPEC.with_(hot_rows=None), ["m_purchase", "m_error"])
    split = clean.impute(p, EVENT_SPEC.with_(hot_rows=4), ["m_purchase", "m_error"])
    _same(plain, split, ["serial_number", "timestamp"])
    only_f = clean.forward_fill(p, EVENT_SPEC.with_(hot_rows=4), ["m_purchase"])
    only_f_plain = clean.forward_fill(p, EVENT_SPEC.with_(hot_rows=None), ["m_purchase"])
    _same(only_f_plain, only_f, ["serial_number", "timestamp"])


def test_split_thresholds_equal_percentile(spark):
    p = event_panel(spark, SF_SMALL)
    from panelwise.plans.segments import hot_entities
    hot = hot_entities(p, EVENT_SPEC.with_(hot_rows=5))
    assert hot is not None
    a = fe.entity_thresholds(p, EVENT_SPEC, ["m_value", "m_purchase"], 0.9, hot)
    b = p.groupBy("serial_number").agg(F.percentile("m_value", 0.9).alias("_thr_m_value"),
                                       F.percentile("m_purchase", 0.9).alias("_thr_m_purchase"))
    _same(a, b, ["serial_number"])


def test_sub_daily_segments_equal_plain(spark):
    import datetime as dt
    base = dt.datetime(2026, 1, 1)
    rows = [("hot", base + dt.timedelta(minutes=7 * i), float((i * 37) % 11) if i % 5 else None) for i in range(900)]
    rows += [("cold", base + dt.timedelta(hours=5 * i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "serial_number string, timestamp timestamp_ntz, x double")
    spec = EVENT_SPEC.with_(measures=("x",), label=None)
    groups = [fe.rolling(("mean", "max", "std"), (7, 30)), fe.lags((1, 7)), fe.deltas((30,)), fe.slope(7, 3),
              fe.rolling_days(("mean",), (2,)), fe.spikes((7,), 0.9)]
    plain = fe.add_features(df, spec.with_(hot_rows=None), groups)
    split = fe.add_features(df, spec.with_(hot_rows=60, segment_seconds=1800), groups)
    _same(plain, split, ["serial_number", "timestamp"])
    row_groups = [g for g in groups if not g.lookback_days]   # 30-minute segments really used
    _same(fe.add_features(df, spec.with_(hot_rows=None), row_groups),
          fe.add_features(df, spec.with_(hot_rows=60, segment_seconds=1800), row_groups),
          ["serial_number", "timestamp"])
    from panelwise.plans.segments import layout
    lay = layout(df, spec.with_(hot_rows=60, segment_seconds=1800), 30)
    assert lay.df.select("_seg").distinct().count() > 10
    f_plain = clean.impute(df, spec.with_(hot_rows=None))
    f_split = clean.impute(df, spec.with_(hot_rows=60, segment_seconds=1800))
    _same(f_plain, f_split, ["serial_number", "timestamp"])
