"""Rows the fixtures do not hold: tied times, NaN, NULL entities, labels and scores, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwise.operators import clean, evaluate, ml, split
from panelwise.operators import features as fe
from panelwise.plans.feature_job import build_features
from panelwise.spec import PanelSpec
from panelwise.streaming.alerts import cooldown_alerts
from panelwise.streaming.incremental import incremental_features, kept_context, restated

T0 = dt.datetime(2024, 1, 1)
SPEC = PanelSpec(measures=("x",), tiebreak=("n",))
SCHEMA = "serial_number string, timestamp timestamp_ntz, n int, x double, failure int"


def panel(spark, rows):
    return spark.createDataFrame([(e, T0 + dt.timedelta(days=d), n, x, f) for e, d, n, x, f in rows], SCHEMA)


def test_interpolation_between_rows_of_one_time(spark):
    p = panel(spark, [("a", 0, 0, 1.0, 0), ("a", 0, 1, None, 0), ("a", 0, 2, 5.0, 0), ("a", 2, 3, None, 0), ("a", 4, 4, 9.0, 0)])
    got = {r.n: r.x for r in clean.impute(p, SPEC).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 5.0, 3: 7.0, 4: 9.0}


@pytest.mark.parametrize("seconds", [86_400, 3_600])
def test_features_do_not_depend_on_hot_rows(spark, seconds):
    rows = [("a", d, d, float("nan") if d % 5 == 0 else float(d % 7), 0) for d in range(25)]
    rows += [(None, d, d, float(d * d % 11), 0) for d in range(25)]
    rows += [("b", d // 8, d, float(d), 0) for d in range(40)]
    p = panel(spark, rows)
    spec = SPEC.with_(segment_seconds=seconds)
    res = []
    for hot in (None, 1000, 5):
        out = fe.add_features(p, spec.with_(hot_rows=hot), fe.default_groups(spec))
        res.append(sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect()), key=repr))
    assert res[0] == res[1] == res[2] and len(res[0]) == len(rows)


def test_unlabelled_rows_are_kept(spark):
    p = panel(spark, [("a", d, d, 1.0, None if d % 5 == 0 else d % 2) for d in range(50)])
    s = split.stratified_split(p, "failure", ["n"], 0.25)
    assert s.count() == 50 and s.filter("failure IS NULL AND split = 'test'").count() == 0
    w = ml.with_class_weights(p)
    assert w.count() == 50 and w.filter("failure IS NULL AND class_weight = 1.0").count() == 10
    assert ml.undersample(p, ["n"]).filter("failure IS NULL").count() == 10


def test_auc_ignores_missing_scores_at_any_partition_count(spark):
    rows = [(i % 3 == 0, None if i % 4 == 0 else float("nan") if i % 9 == 0 else ((i * 37) % 100) / 100) for i in range(400)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "failure int, score double")
    kept = [(y, s) for y, s in rows if s is not None and s == s]
    pos, neg = [s for y, s in kept if y], [s for y, s in kept if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert evaluate.auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_alert_of_two_at_one_time(spark):
    spec = PanelSpec()
    rows = [("a", T0, 1), ("a", T0, 2), (None, T0, 3), ("a", T0 + dt.timedelta(hours=3), 4), ("a", T0 + dt.timedelta(minutes=30), 5)]
    c = spark.createDataFrame(rows, "serial_number string, timestamp timestamp_ntz, k int")
    for hot in (None, 0):
        sent = cooldown_alerts(c, spec, 60, hot_rows=hot)
        assert sorted(map(str, ((r.serial_number, r.timestamp) for r in sent.collect()))) == sorted(
            map(str, [("a", T0), (None, T0), ("a", T0 + dt.timedelta(hours=3))]))


def test_late_rows_have_the_features_of_a_full_run(spark):
    rows = [(e, d, 0, float((d * 7 + ord(e)) % 13), 0) for e in "ab" for d in range(40)]
    late = [r for r in rows if (r[0], r[1]) in {("a", 33), ("a", 39), ("b", 36)}]
    history = panel(spark, [r for r in rows if r not in late])
    new = panel(spark, late)
    groups = fe.default_groups(SPEC, spike=False)
    full = {(r.serial_number, r.timestamp): r for r in fe.add_features(panel(spark, rows), SPEC, groups).collect()}
    got = incremental_features(history, new, SPEC, groups).collect()
    assert len(got) == 3 and all(r == full[r.serial_number, r.timestamp] for r in got)
    assert restated(history, new, SPEC).count() == 5 + 3
    kept = kept_context(panel(spark, rows), SPEC, 3, "2 days")
    assert kept.count() == 2 * (3 + 3)


def test_statistics_are_fitted_on_the_training_rows(spark):
    rows = [(e, d, 0, float(d) if d < 20 else 1000.0, 0) for e in "ab" for d in range(25)]
    p = panel(spark, rows).withColumn("model", F.lit("m1"))
    train = F.col("timestamp") < F.lit("2024-01-21").cast("timestamp_ntz")
    res = build_features(p, SPEC, scale_method="zscore", groups=[fe.rolling(("mean",), (7,))], fit_on=train)
    out = res.features
    assert "model" in out.columns and "x_mean_7d_scaled" in out.columns and out.count() == 50
    mean = sum(range(20)) / 20
    sd = (sum((d - mean) ** 2 for d in range(20)) * 2 / 39) ** 0.5
    top = out.agg(F.max("x_scaled")).first()[0]  # clipped to mean + 3 sd of the training rows
    assert top == pytest.approx(3.0, abs=1e-9) and sd > 0


def test_bursts_are_cut_by_their_row_counts(spark):
    """90 % of an entity's rows in 3 % of its days, and one day with very many."""
    from panelwise.plans.segments import SEG, layout

    rows = [("a", T0 + dt.timedelta(days=d), i, float(i % 7), 0) for d in range(100) for i in range(10)]
    rows += [("a", T0 + dt.timedelta(days=50 + d, seconds=7 * i), 1000 + i, float(i % 11), 0) for d in range(3) for i in range(1500)]
    rows += [("a", T0 + dt.timedelta(days=80, seconds=i), 5000 + i, float(i % 13), 0) for i in range(4000)]
    rows += [("b", T0 + dt.timedelta(days=d), 0, 1.0, 0) for d in range(30)]
    p = spark.createDataFrame(rows, SCHEMA)
    spec = SPEC.with_(hot_rows=500)
    sizes = layout(p, spec).df.filter("serial_number = 'a'").groupBy(SEG).count().collect()
    assert max(r["count"] for r in sizes) <= 1000 and len(sizes) >= 10
    groups = [fe.rolling(("mean", "max"), (7,)), fe.lags((3,))]
    a, b = (sorted(map(tuple, fe.add_features(p, spec.with_(hot_rows=h), groups).collect()), key=repr) for h in (None, 500))
    assert len(a) == len(rows) and a == b
