"""Hand panels (FIXTURES 'Hand panels') for windows, fills and quantiles."""

import datetime as dt
import math

import pytest

from panelwise.operators import clean
from panelwise.operators import features as fe
from panelwise.spec import PanelSpec

SPEC = PanelSpec(measures=("x",), label=None, hot_rows=None)


def day(i):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=i)


def panel(spark, data):
    return spark.createDataFrame([(e, day(d), x) for e, d, x in data],
                                 "serial_number string, timestamp timestamp_ntz, x double")


def col_of(df, name):
    return [r[name] for r in df.orderBy("serial_number", "timestamp").collect()]


def test_rolling_and_std_single_row_is_zero(spark):
    df = panel(spark, [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, None), ("a", 3, 8.0)])
    out = fe.add_features(df, SPEC, [fe.rolling(("mean", "max", "min", "std"), (2,))])
    assert col_of(out, "x_mean_2d") == [1.0, 2.0, 3.0, 8.0]
    assert col_of(out, "x_max_2d") == [1.0, 3.0, 3.0, 8.0]
    assert col_of(out, "x_std_2d")[0] == 0.0            # one row -> 0
    assert col_of(out, "x_std_2d")[1] == pytest.approx(math.sqrt(2.0))


def test_window_longer_than_series(spark):
    df = panel(spark, [("a", i, float(i)) for i in range(6)])
    out = fe.add_features(df, SPEC, [fe.rolling(("mean",), (7,)), fe.spikes((7,), 0.9)])
    assert col_of(out, "x_mean_7d") == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    assert col_of(out, "x_spike_7d") == [0.0] * 6          # fewer than 7 rows


def test_delta_lag_trend_docs_example(spark):
    # worked numbers of the reference docs: delta = current - value 7 rows back; trend 5/7
    df = panel(spark, [("a", i, 0.0 if i < 7 else 5.0) for i in range(8)])
    out = fe.add_features(df, SPEC, [fe.deltas((7,)), fe.lags((1,)), fe.trends((7,))])
    assert col_of(out, "x_delta_7d")[-1] == 5.0
    assert col_of(out, "x_trend_7d")[-1] == pytest.approx(5.0 / 7)
    assert col_of(out, "x_lag_1d") == [0.0] * 8


def test_no_leak_between_entities(spark):
    df = panel(spark, [("a", 0, 1.0), ("a", 1, 9.0), ("b", 0, None), ("b", 1, 2.0)])
    out = fe.add_features(df, SPEC, [fe.lags((1,)), fe.rolling(("mean",), (3,))])
    rows = {(r.serial_number, r.timestamp.day): r for r in out.collect()}
    assert rows[("b", 2)].x_lag_1d == 0.0          # previous b value is NULL, not a's 9
    assert rows[("b", 2)].x_mean_3d == 2.0
    filled = clean.forward_fill(df, SPEC)
    frow = {(r.serial_number, r.timestamp.day): r.x for r in filled.collect()}
    assert frow[("b", 1)] is None                  # b's first row is not filled from a
    assert frow[("b", 2)] == 2.0


def test_slope_needs_three_values(spark):
    df = panel(spark, [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("a", 3, None)])
    out = fe.add_features(df, SPEC, [fe.slope(7, 3)])
    assert col_of(out, "x_slope_7d") == [0.0, 0.0, pytest.approx(2.0), pytest.approx(2.0)]


def test_constant_measure(spark):
    df = panel(spark, [("a", i, 4.0) for i in range(5)])
    out = fe.add_features(df, SPEC, [fe.rolling(("std",), (3,)), fe.spikes((3,), 0.9)])
    assert set(col_of(out, "x_std_3d")) == {0.0}
    assert set(col_of(out, "x_spike_3d")) == {0.0}


def test_tie_on_time_uses_tiebreak(spark):
    spec = SPEC.with_(tiebreak=("seq",))
    df = spark.createDataFrame([("a", day(0), 1, 1.0), ("a", day(0), 2, 5.0), ("a", day(1), 1, 7.0)],
                               "serial_number string, timestamp timestamp_ntz, seq int, x double")
    out = fe.add_features(df, spec, [fe.lags((1,))])
    got = [r.x_lag_1d for r in out.orderBy("timestamp", "seq").collect()]
    assert got == [0.0, 1.0, 5.0]


def test_impute_gap_inside_start_end_and_all_null(spark):
    df = panel(spark, [("a", 0, None), ("a", 1, 2.0), ("a", 3, None), ("a", 5, 8.0), ("a", 6, None),
                       ("z", 0, None), ("z", 1, None)])
    out = clean.impute(df, SPEC)
    got = {(r.serial_number, r.timestamp.day - 1): r.x for r in out.collect()}
    assert got[("a", 0)] == 2.0                    # leading: backward fill
    assert got[("a", 3)] == pytest.approx(5.0)     # inside: 2 + (8 - 2) * (3 - 1) / (5 - 1)
    assert got[("a", 6)] == 8.0                    # trailing: forward fill
    assert got[("z", 0)] == 0.0 and got[("z", 1)] == 0.0


def test_nan_and_null_are_both_missing(spark):
    df = panel(spark, [("a", 0, 1.0), ("a", 1, float("nan")), ("a", 2, None), ("a", 3, 4.0)])
    df = clean.nan_as_null(df, ["x"])
    out = clean.impute(df, SPEC)
    assert col_of(out, "x") == [1.0, pytest.approx(2.0), pytest.approx(3.0), 4.0]


def test_clip_keeps_null(spark):
    df = panel(spark, [("a", i, float(v)) for i, v in enumerate([1, 2, 3, 2, 1, 2, 3, 100])] + [("a", 9, None)])
    out = clean.clip_outliers(df, ["x"], 1.0)
    vals = col_of(out, "x")
    assert vals[-1] is None and max(v for v in vals if v is not None) < 100


def test_entity_thresholds_match_numpy(spark):
    import numpy as np
    data = [("a", i, float(v)) for i, v in enumerate([5, 1, 9, 3, 7, 7, 2])] + [("b", 0, None)]
    df = panel(spark, data)
    t = {r.serial_number: r["_thr_x"] for r in fe.entity_thresholds(df, SPEC, ["x"], 0.9).collect()}
    assert t["a"] == pytest.approx(np.percentile([5, 1, 9, 3, 7, 7, 2], 90))
    assert t["b"] is None


def test_calendar_frame(spark):
    df = panel(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 5, 10.0)])
    out = fe.add_features(df, SPEC, [fe.rolling_days(("mean",), (3,))])
    assert col_of(out, "x_mean_3days") == [1.0, 1.5, 10.0]


def test_feature_names_contract():
    from panelwise.spec import feature_names
    names = feature_names(PanelSpec(measures=tuple(f"m{i}" for i in range(19))), spikes=False, slope=False)
    # 19 base + 19 x 5 x 3 windows + 19 x 3 lags + 19 x 2 trends: the G3 count (399)
    assert len(names) == 399
