"""Saved statistics, restated rows and sketches against full recomputation."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import clean, features as fe, scale, sketches
from panelwise.plans.materialize import fresh_dir, written
from panelwise.spec import PanelSpec
from panelwise.streaming import saved_state
from panelwise.streaming.incremental import incremental_features, latest_scores, score_stream

SPEC = PanelSpec(measures=("x", "y"), hot_rows=None)
SCHEMA = "serial_number string, timestamp timestamp_ntz, x double, y double"
GROUPS = [fe.spikes((3, 7), 0.8), fe.rolling_days(("mean",), (5,)), fe.rolling(("max",), (3,))]


def panel(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for ent in ("a", "b", "c", None):
        for d in range(n):
            if r.random() < 0.8:
                out.append((ent, dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=r.randrange(24)), round(r.gauss(10, 4), 1),
                            r.choice([None, float("nan"), 1.0, 2.0, 2.0])))
    return out


def feats(df):
    cols = [c for c in df.columns if c not in ("replaced",)]
    return sorted([tuple(None if v != v else (round(v, 9) if isinstance(v, float) else v) for v in (r[c] for c in sorted(cols)))
                   for r in df.collect()], key=repr)


def test_states_merge_and_spikes_on_increments_equal_the_full_run(spark):
    rows = panel()
    cut = dt.datetime(2026, 2, 20)
    late = [r for i, r in enumerate(rows) if r[1] >= cut or i % 37 == 0]  # some new rows are old ones that come late
    old = [r for r in rows if r not in late]
    mk = lambda x: spark.createDataFrame(x, SCHEMA)
    states = [saved_state.state_of(mk(old[i::3]), SPEC) for i in range(3)]
    state = written(saved_state.merged(SPEC, *states), "test-state")
    whole = saved_state.state_of(mk(old), SPEC)
    assert sorted(map(tuple, state.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    full = feats(fe.add_features(mk(rows), SPEC, GROUPS))
    key = {(r[0], r[1]) for r in late}
    inc = incremental_features(mk(old), mk(late), SPEC, GROUPS, state=state)
    want = feats(fe.add_features(mk(rows), SPEC, GROUPS).withColumn("k", F.struct("serial_number", "timestamp")).drop("k"))
    names = sorted(inc.columns)
    at = names.index("serial_number"), names.index("timestamp")
    assert feats(inc) == [r for r in want if (r[at[0]], r[at[1]]) in key] and len(full) == len(want)
    again = incremental_features(mk(old), mk(late), SPEC, GROUPS, state=state, restate=True)
    first = {}
    for e, t, *_ in late:
        first[e] = min(first.get(e, t), t)
    moved = {(e, t) for e, t, *_ in old if e in first and t > first[e]}
    got = feats(again)
    assert got == [r for r in want if (r[at[0]], r[at[1]]) in key | moved]
    assert {(r.serial_number, r.timestamp) for r in again.filter("replaced").collect()} == moved
    with pytest.raises(ValueError):
        incremental_features(mk(old), mk(late), SPEC, GROUPS)


def test_scaling_and_clipping_from_the_state(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    clear = df.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    state, cols = saved_state.state_of(df, SPEC), ["x", "y"]
    for mine, full in ((saved_state.zscore_stats(state, cols), scale.fit_zscore(clear, cols)), (saved_state.robust_stats(state, cols), scale.fit_robust(clear, cols)),
                       (saved_state.minmax_stats(state, cols), scale.fit_minmax(clear, cols))):
        a, b = mine.first().asDict(), full.first().asDict()
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k], rel=1e-12)
    new = spark.createDataFrame([("a", dt.datetime(2026, 5, 1), 500.0, None), ("q", dt.datetime(2026, 5, 1), -500.0, 2.0)], SCHEMA)
    got = saved_state.clipped(new, state, cols).collect()
    want = clean.clip_outliers(new, cols, fit_on=clear).collect()
    for g, w in zip(got, want):
        assert g.x == pytest.approx(w.x) and g.y == w.y
    none = saved_state.state_of(df.limit(0), SPEC)
    assert saved_state.zscore_stats(none, cols).first().asDict() == {"mean__x": 0.0, "std__x": 1.0, "mean__y": 0.0, "std__y": 1.0}


def test_a_hot_value_is_one_line(spark):
    df = spark.range(30_000).select(F.lit("hot").alias("serial_number"), F.lit(dt.datetime(2026, 1, 1)).cast("timestamp_ntz").alias("timestamp"),
                                    F.when(F.col("id") < 20_000, 1.0).otherwise(F.col("id") % 50).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    state = saved_state.state_of(df, SPEC)
    assert state.count() == 50 and state.agg(F.sum("n")).first()[0] == 30_000
    thr = saved_state.thresholds(state, SPEC, ["x"], 0.9).first()
    want = df.agg(F.percentile("x", 0.9)).first()[0]
    assert thr["_thr_x"] == pytest.approx(want)


def test_restated_stream_after_a_retried_batch(spark):
    rows = panel(40, 3)
    r = random.Random(8)
    rows = [x for x in rows if x[0] is not None]
    rows.sort(key=lambda x: x[1] + dt.timedelta(days=r.randrange(0, 4)))
    base, groups = fresh_dir(spark, "restate"), [fe.rolling(("mean", "max"), (5,))]
    n = -(-len(rows) // 4)
    for i in range(4):
        spark.createDataFrame(rows[i * n:(i + 1) * n], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    score_stream(spark, f"{base}/in", schema, SPEC, groups, lambda f: f, f"{base}/out", f"{base}/ctx", f"{base}/ck", 1, "5 days", restate=True)
    full = fe.add_features(spark.createDataFrame(rows, SCHEMA), SPEC, groups)
    out_schema = full.withColumn("replaced", F.lit(True)).schema
    got = latest_scores(spark, f"{base}/out", out_schema, SPEC)
    assert spark.read.parquet(f"{base}/out").filter("replaced").count() > 0
    assert feats(got.select(*full.columns)) == feats(full)
    # a retried batch writes its folder again: the same last word
    again = spark.read.schema(out_schema).parquet(f"{base}/out/batch=2")
    saved = written(again, "retry")
    saved.write.mode("overwrite").parquet(f"{base}/out/batch=2")
    assert feats(latest_scores(spark, f"{base}/out", out_schema, SPEC).select(*full.columns)) == feats(full)


def test_sketch_ranks(spark):
    r = np.random.default_rng(4)
    values = np.concatenate([r.lognormal(2, 1, 40_000), np.full(20_000, 7.5)])
    rows = spark.createDataFrame([(float(v), int(i % 20)) for i, v in enumerate(values)], "x double, d int")
    df = rows.select(F.lit("e").alias("serial_number"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")).cast("timestamp_ntz").alias("timestamp"), "x")
    days = sketches.daily(df, SPEC, ["x"])
    assert days.count() == 20
    keep = np.sort(values[[i for i in range(len(values)) if 5 <= i % 20 <= 14]])
    merged = sketches.window(days, F.lit("2026-01-06").cast("date"), F.lit("2026-01-15").cast("date"))
    for a in sketches.quantiles(merged, [0.01, 0.1, 0.5, 0.9, 0.99]).collect():
        lo, hi = np.searchsorted(keep, a.value, "left") / len(keep), np.searchsorted(keep, a.value, "right") / len(keep)
        assert lo - sketches.rank_error() <= a.q <= hi + sketches.rank_error() and a.n == len(keep)
    got = sketches.robust_stats(merged, ["x"]).first()
    assert got["median__x"] == 7.5 and got["iqr__x"] > 0
    empty = sketches.daily(df.limit(0), SPEC, ["x"])
    assert sketches.robust_stats(sketches.window(empty, F.lit("2026-01-06").cast("date"), F.lit("2026-01-15").cast("date")), ["x"]).first().asDict() == \
        {"median__x": 0.0, "iqr__x": 1.0}
