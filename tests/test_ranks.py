import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import evaluate as ev
from panelwise.plans.ranks import global_quantiles, group_quantiles, running_totals


def test_running_totals_match_cumsum(spark):
    keys = list(range(500))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, w long")
    out = running_totals(df, ["k"], {"cum": F.col("w")}).orderBy("k").collect()
    assert [r.cum for r in out] == list(itertools.accumulate(k % 7 for k in range(500)))


def test_group_quantiles_with_hot_group_and_duplicates(spark):
    rng = random.Random(7)
    data = [("hot", float(rng.randint(0, 50))) for _ in range(3000)] + \
           [(f"g{i}", float(rng.random())) for i in range(40) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(data, "g string, v double")
    out = {r.g: (r.p10, r.p90) for r in group_quantiles(df, ["g"], "v", {"p10": 0.1, "p90": 0.9}, parts=16).collect()}
    for g in {d[0] for d in data}:
        vals = [v for k, v in data if k == g]
        assert out[g][0] == pytest.approx(np.percentile(vals, 10))
        assert out[g][1] == pytest.approx(np.percentile(vals, 90))


def test_global_quantiles_empty_is_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    r = global_quantiles(df, "v", {"m": 0.5}).collect()
    assert len(r) == 1 and r[0].m is None


def test_auc_matches_pairs(spark):
    rng = random.Random(3)
    data = [(rng.choice([0, 1]), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "failure int, score double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ev.auc(df).collect()[0].auc == pytest.approx(brute)


def test_threshold_search_first_best(spark):
    data = [(1, 0.9), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    df = spark.createDataFrame(data, "failure int, score double")
    out = ev.threshold_search(df).orderBy("threshold").collect()
    assert len(out) == 16
    best = [r for r in out if r.best]
    assert len(best) == 1
    f1s = [r.f1 for r in out]
    assert best[0].f1 == max(f1s) and best[0].threshold == min(r.threshold for r in out if r.f1 == max(f1s))


def test_metrics_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "failure int, prediction int")
    m = ev.metrics(df).collect()[0]
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 2)
    assert m.accuracy == pytest.approx(0.6)
    rep = {r.cls: r for r in ev.class_report(df).collect()}
    assert rep[1].precision == pytest.approx(0.5) and rep[0].support == 3
