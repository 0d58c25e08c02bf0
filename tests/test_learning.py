"""Online learning, compiled models, node tables and patience against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.catalog import models as M
from panelwise.operators import ml, online, split, trees
from panelwise.plans.materialize import fresh_dir

from .conftest import SF_SMALL


def test_online_equals_a_plain_version(spark):
    r = random.Random(2)
    batches = [[(r.gauss(3, 2), r.uniform(-1, 1), 5.0, int(r.random() < 0.3)) for _ in range(50)] for _ in range(4)]
    batches[1] += [(None, 1.0, 5.0, 1), (float("nan"), 1.0, 5.0, 1), (1.0, 1.0, 5.0, None)]
    state, path = online.Online(("b", "a", "c")), fresh_dir(spark, "online-test")
    first = np.array([x[:3] for x in batches[0]])
    mean, dev = first.mean(0), first.std(0)
    dev[dev == 0] = 1.0
    w, w0 = np.zeros(3), 0.0
    for t, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3)
        state = online.learn(df, state, "y", rate=0.7, l2=0.05)
        online.save(state, spark, f"{path}/{t}")
        state = online.load(spark, f"{path}/{t}")
        good = np.array([x for x in rows if None not in x and not any(math.isnan(v) for v in x)])
        x, y = (good[:, :3] - mean) / dev, good[:, 3]
        e = 1 / (1 + np.exp(-(w0 + x @ w))) - y
        size = 0.7 / math.sqrt(t + 1)
        w, w0 = w - size * (e @ x / len(y) + 0.05 * w), w0 - size * e.mean()
        assert state.features == ("a", "b", "c") and state.step == t + 1
        np.testing.assert_allclose([*state.coefficients, state.intercept], [*w, w0], rtol=1e-10, atol=1e-12)
    p = df.dropna().filter(~F.isnan("a")).select("a", "b", "c", state.probability().alias("p")).collect()
    for q in p:
        assert q.p == pytest.approx(1 / (1 + math.exp(-(w0 + (np.array([q.a, q.b, q.c]) - mean) / dev @ w))))


def test_online_edges(spark):
    state = online.Online(("a",))
    empty = spark.createDataFrame([], "a double, y int")
    assert online.learn(empty, state, "y") == state
    path = fresh_dir(spark, "online-test")
    online.save(state, spark, path)
    assert online.load(spark, path) == state
    more = online.learn(spark.createDataFrame([(1.0, 1), (2.0, 0)], "a double, y int"), state, "y")
    assert online.learn(empty, more, "y") == more and more.step == 1


@pytest.fixture(scope="module")
def fitted(spark):
    train, test, feats = M._train_test(spark, SF_SMALL)
    kinds = {"rf": M.SMALL_RF, "gbt": M.SMALL_GBT, "lr": dict(maxIter=20)}
    return train, test, feats, {k: ml.pipeline(feats, ml.estimator(k, **p)).fit(train) for k, p in kinds.items()}


def test_compiled_models_score_alike(fitted):
    train, test, feats, models = fitted
    rows = test.unionByName(test.withColumn(feats[0], F.lit(None).cast("double")), allowMissingColumns=True)
    for model in models.values():
        out = ml.probability(model.transform(rows)).withColumn("c", trees.compiled(model, feats))
        gap = out.filter(F.col(feats[0]).isNotNull()).agg(F.max(F.abs(F.col("c") - F.col(ml.PROB)))).first()[0]
        assert gap < 1e-12
    tree_rows = ml.probability(models["rf"].transform(rows)).withColumn("c", trees.compiled(models["rf"], feats))
    assert tree_rows.agg(F.max(F.abs(F.col("c") - F.col(ml.PROB)))).first()[0] < 1e-12  # missing values too


def test_importance_is_one_aggregation_over_nodes(fitted):
    _, _, feats, models = fitted
    for kind in ("rf", "gbt"):
        got = {r.feature: r.importance for r in trees.importance(trees.node_table(models[kind], feats), kind == "rf").collect()}
        for f, want in zip(feats, models[kind].stages[-1].featureImportances.toArray()):
            assert got.get(f, 0.0) == pytest.approx(want, abs=1e-12)


def test_worth_on_the_training_rows_gives_back_the_gains(spark):
    r = random.Random(5)
    rows = [(r.random(), r.random()) for _ in range(400)]
    df = spark.createDataFrame([(a, b, int(a + 0.3 * b > 0.7)) for a, b in rows], "a double, b double, failure int")
    model = ml.pipeline(["a", "b"], ml.estimator("rf", numTrees=1, maxDepth=4, minInstancesPerNode=5, subsamplingRate=1.0,
                                                 featureSubsetStrategy="all", bootstrap=False)).fit(df)
    table = trees.node_table(model, ["a", "b"])
    want = {r.node: (r.gain, r.rows) for r in table.filter("feature is not null").collect()}
    got = {r.node: (r.gain, r.rows) for r in trees.worth(df, trees.nodes_of(table)).collect()}
    assert got.keys() == want.keys()
    for node, (gain, n) in want.items():
        assert got[node] == (pytest.approx(gain, abs=1e-9), n)


@pytest.mark.parametrize("losses, patience, want", [
    ([5, 4, 3, 2, 1], 2, (5, False)), ([5, 3, 4, 4, 1], 2, (2, True)), ([5, 3, 4, 1, 2, 2, 2], 3, (4, True)),
    ([1, 1, 1], 2, (1, True)), ([3], 5, (1, False)), ([3, 2, 2, 1], 2, (4, False))])
def test_best_round(losses, patience, want):
    assert ml.best_round(losses, patience) == want


def test_patient_boosting_is_cut_at_the_best_round(spark, fitted):
    train, test, feats, _ = fitted
    noisy = train.withColumn("failure", F.when(F.pmod(F.xxhash64("serial_number", "timestamp"), F.lit(4)) == 0, 1 - F.col("failure"))
                             .otherwise(F.col("failure")))
    model, losses = ml.patient_gbt(noisy, test, feats, patience=3, max_iter=32, first=8, maxDepth=3)
    best, settled = ml.best_round(losses, 3)
    assert settled and model.stages[-1].getNumTrees == best < len(losses)
    plain = ml.pipeline(feats, ml.estimator("gbt", maxDepth=3, maxIter=best)).fit(noisy)
    a = ml.probability(model.transform(test)).agg(F.sum(ml.PROB)).first()[0]
    assert a == pytest.approx(ml.probability(plain.transform(test)).agg(F.sum(ml.PROB)).first()[0], abs=1e-9)
    path = fresh_dir(spark, "patient")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(path)
    assert again.stages[-1].getNumTrees == best
    assert ml.probability(again.transform(test)).agg(F.sum(ml.PROB)).first()[0] == pytest.approx(a, abs=1e-9)


def test_boosting_with_patience_fits_few_rounds_twice(spark, fitted, monkeypatch):
    train, test, feats, _ = fitted
    rounds, plain = [], ml.estimator
    monkeypatch.setattr(ml, "estimator", lambda kind, label, **p: rounds.append(p["maxIter"]) or plain(kind, label, **p))
    model, losses = ml.patient_gbt(train, test, feats, patience=100, max_iter=16, first=4, maxDepth=2)
    assert rounds == [4, 16] and len(losses) == 16  # 4, 8, 16 before
    rounds.clear()
    monkeypatch.setattr(ml, "best_round", lambda x, patience: (len(x), len(x) >= 8))
    model, losses = ml.patient_gbt(train, test, feats, patience=1, max_iter=32, first=4, maxDepth=2)
    assert rounds == [4, 16] and len(losses) == 8 == model.stages[-1].getNumTrees  # judged where it was before


def test_grid_search_assembles_before_the_folds(spark, fitted, monkeypatch):
    from pyspark.ml.tuning import CrossValidator

    train, test, feats, _ = fitted
    train = split.fold_column(train, ["serial_number"], 2, 42)
    seen, fit = [], CrossValidator.fit
    monkeypatch.setattr(CrossValidator, "fit", lambda self, df: seen.append(df.columns) or fit(self, df))
    args = dict(folds=2, parallelism=2, fold_col="fold", minInstancesPerNode=5)
    model, best = ml.grid_search(train, feats, "rf", {"numTrees": [3], "maxDepth": [2, 3]}, **args)
    assert seen == [["features", "failure", "fold"]]
    est = ml.estimator("rf", numTrees=3, minInstancesPerNode=5)
    plain = CrossValidator(estimator=ml.pipeline(feats, est), estimatorParamMaps=[{est.maxDepth: 2}, {est.maxDepth: 3}],
                           evaluator=ml.evaluator(), numFolds=2, seed=42).setFoldCol("fold")
    assert best == pytest.approx(max(fit(plain, train).avgMetrics), abs=1e-12)
    assert ml.probability(model.transform(test)).count() == test.count()
