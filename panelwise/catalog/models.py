"""Model queries on P1 (rows-only checks): training, search, voting, importance, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions.scalar import r6
from ..operators import clean, ml, split
from ..operators import smote as synthetic
from ..plans.materialize import materialize
from ..operators import features as fe
from ..sources.tables import EVENT_SPEC, event_panel
from ..streaming.incremental import fresh_dir
from . import register
from .common import E, P1, TS, rounded, sql_r6

SMALL_RF = dict(numTrees=20, maxDepth=5, minInstancesPerNode=5, maxBins=32)
SMALL_GBT = dict(maxIter=10, maxDepth=3)
KEYS = [E, "timestamp", "failure"]


def training_frame(spark, sf_dir):
    """P1 -> imputation -> features for the measures -> time split column."""
    p = event_panel(spark, sf_dir)
    p = clean.impute(p, EVENT_SPEC)
    groups = [fe.rolling(("mean", "max", "std"), (7,)), fe.deltas((7,)), fe.lags((1,)), fe.slope(7, 3)]
    f = fe.add_features(p, EVENT_SPEC, groups)
    f = f.withColumn("n_events", F.col("n_events").cast("double"))
    feats = EVENT_SPEC.feature_columns(f)
    # read by several fits / folds: saved once to the shared checkpoint folder
    return materialize(split.time_split(f, EVENT_SPEC, 0.8)), feats


def _train_test(spark, sf_dir):
    f, feats = training_frame(spark, sf_dir)
    return f.filter(F.col("split") == "train"), f.filter(F.col("split") == "test"), feats


def _scores(spark, sf_dir, kind, params):
    train, test, feats = _train_test(spark, sf_dir)
    model = ml.pipeline(feats, ml.estimator(kind, **params)).fit(train)
    return ml.score(model, test, KEYS)


@register("rf_scores")
def rf_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "rf", SMALL_RF)


@register("gbt_scores")
def gbt_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "gbt", SMALL_GBT)


@register("lr_scores")
def lr_scores(spark, sf_dir):
    return _scores(spark, sf_dir, "lr", dict(maxIter=20))


@register("best_model")
def best_model(spark, sf_dir):
    train, test, feats = _train_test(spark, sf_dir)
    _, metrics = ml.fit_best(train, test, feats, {"rf": SMALL_RF, "gbt": SMALL_GBT, "lr": dict(maxIter=20)})
    return metrics


@register("soft_vote")
def soft_vote(spark, sf_dir):
    train, test, feats = _train_test(spark, sf_dir)
    models = {k: ml.pipeline(feats, ml.estimator(k, **p)).fit(train)
              for k, p in {"rf": SMALL_RF, "gbt": SMALL_GBT, "lr": dict(maxIter=20)}.items()}
    return ml.soft_vote(models, test, [E, "timestamp"])


@register("grid_search")
def grid_search(spark, sf_dir):
    train, _, feats = _train_test(spark, sf_dir)
    _, best = ml.grid_search(train, feats, "rf", {"numTrees": [5, 10], "maxDepth": [3, 5]}, folds=3,
                             parallelism=2, minInstancesPerNode=5, maxBins=32)
    return spark.range(1).select(F.lit(best).alias("best_cv_auc"))


@register("random_search")
def random_search(spark, sf_dir):
    train, _, feats = _train_test(spark, sf_dir)
    bounds = {"maxDepth": (2, 4), "stepSize": (0.05, 0.3), "subsamplingRate": (0.6, 1.0), "maxIter": (5, 10)}
    _, best = ml.random_search(train, feats, n=3, parallelism=2, bounds=bounds)
    return spark.range(1).select(F.lit(best).alias("best_validation_auc"))


@register("early_stop_gbt")
def early_stop_gbt(spark, sf_dir):
    train, test, feats = _train_test(spark, sf_dir)
    train = split.hash_split(train, [E, "timestamp"], 0.2).withColumn(
        "is_valid", F.col("split") == "test").drop("split")
    model = ml.early_stop_gbt(train, feats, "is_valid", max_iter=30, maxDepth=3)
    return ml.score(model, test, KEYS).withColumn("trees", F.lit(model.stages[-1].getNumTrees))


@register("class_weighted_rf")
def class_weighted_rf(spark, sf_dir):
    train, test, feats = _train_test(spark, sf_dir)
    train = ml.with_class_weights(train)
    model = ml.pipeline(feats, ml.estimator("rf", weight_col="class_weight", **SMALL_RF)).fit(train)
    return ml.score(model, test, KEYS)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    train, _, feats = _train_test(spark, sf_dir)
    model = ml.pipeline(feats, ml.estimator("rf", **SMALL_RF)).fit(train)
    return ml.importances(model, feats)


@register("importance_select")
def importance_select(spark, sf_dir):
    return ml.select_by_importance(feature_importance(spark, sf_dir))


_DAYNO = f"date_diff('day', DATE '1970-01-01', CAST({TS} AS DATE))"
_HASH = f"CAST('0x' || substr(md5(concat_ws('|', '42', {E}, CAST({_DAYNO} AS VARCHAR))), 1, 8) AS BIGINT)"


@register("undersample", f"{P1}, c AS (SELECT count(*) FILTER (failure = 1) AS pos, count(*) FILTER (failure = 0) AS neg FROM p) "
          f"SELECT {E}, {TS}, failure FROM p, c WHERE failure = 1 OR failure IS NULL OR "
          f"{_HASH} < floor(CASE WHEN neg = 0 THEN 1.0 ELSE least(1.0, CAST(pos AS DOUBLE) / neg) END * 4294967296.0)")
def undersample(spark, sf_dir):
    p = event_panel(spark, sf_dir).select(*KEYS).withColumn("_dayno", F.unix_date(F.to_date("timestamp")))
    return ml.undersample(p, [E, "_dayno"], "failure", 1.0, 42).select(*KEYS)


@register("hash_split", f"{P1} SELECT {E}, {TS}, failure, CASE WHEN {_HASH} < {int(0.2 * 16 ** 8)} THEN 'test' ELSE 'train' END AS split FROM p")
def hash_split(spark, sf_dir):
    """SPL2, reproducible: the side of a row follows from its key alone."""
    p = event_panel(spark, sf_dir).select(*KEYS).withColumn("_dayno", F.unix_date(F.to_date("timestamp")))
    return split.hash_split(p, [E, "_dayno"], 0.2, 42).drop("_dayno")


@register("fold_column", f"{P1} SELECT {E}, {TS}, failure, CAST({_HASH} % 5 AS INTEGER) AS fold FROM p")
def fold_column(spark, sf_dir):
    """SPL4: five folds by key hash."""
    p = event_panel(spark, sf_dir).select(*KEYS).withColumn("_dayno", F.unix_date(F.to_date("timestamp")))
    return split.fold_column(p, [E, "_dayno"], 5, 42).drop("_dayno")


@register("random_split")
def random_split(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    train, test = split.random_split(p, (0.8, 0.2), 42)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@register("rolling_origin_cv")
def rolling_origin_cv(spark, sf_dir):
    """SPL5 with fits: one logistic model per fold, AUC on that fold's test window."""
    f, feats = training_frame(spark, sf_dir)
    folds = split.rolling_origin(f.drop("split"), EVENT_SPEC, 3)
    ev = ml.evaluator()
    rows = []
    for k in range(3):
        tr = folds.filter((F.col("fold") == k) & (F.col("role") == "train"))
        te = folds.filter((F.col("fold") == k) & (F.col("role") == "test"))
        model = ml.pipeline(feats, ml.estimator("lr", maxIter=20)).fit(tr)
        rows.append((k, float(ev.evaluate(model.transform(te)))))
    return spark.createDataFrame(rows, "fold int, auc double")


@register("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """SNK4/SNK5: save the fitted pipeline to the shared folder, load it, score."""
    train, test, feats = _train_test(spark, sf_dir)
    model = ml.pipeline(feats, ml.estimator("lr", maxIter=20)).fit(train)
    path = fresh_dir(spark, "model")
    sinks.save_model(model, path)
    return ml.score(sinks.load_model(path), test, KEYS)


@register("scored_with_indicators")
def scored_with_indicators(spark, sf_dir):
    """ML20 + ML21: test rows scored by a forest, each carrying the top-5 feature names."""
    from ..operators.score import key_indicators
    train, test, feats = _train_test(spark, sf_dir)
    model = ml.pipeline(feats, ml.estimator("rf", **SMALL_RF)).fit(train)
    top = key_indicators(ml.importances(model, feats), 5)
    return ml.score(model, test, KEYS).withColumn("key_indicators", top)


@register("retrain_window")
def retrain_window(spark, sf_dir):
    """ML23: features written partitioned, the last 20 days read back with partition
    pruning, a model refitted on them, the last 3 days scored."""
    from .. import sinks
    from ..sources.readers import read_features
    from ..streaming.incremental import fresh_dir as _fresh
    f, feats = training_frame(spark, sf_dir)
    path = _fresh(spark, "retrain")
    sinks.write_partitioned(f.drop("split"), path, EVENT_SPEC)
    last = f.select(F.max("timestamp")).scalar()
    stored = read_features(spark, path, start=F.date_sub(F.to_date(last), 20).cast("timestamp_ntz"), spec=EVENT_SPEC)
    model = ml.retrain_window(stored, "timestamp", F.date_sub(F.to_date(last), 20).cast("timestamp_ntz"), feats,
                              "lr", maxIter=20)
    recent = stored.filter(F.col("timestamp") >= F.date_sub(F.to_date(last), 2).cast("timestamp_ntz"))
    return ml.score(model, recent, KEYS)


_SMOTE = ["m_value", "m_purchase", "m_error", "n_events"]
_SMOTE_K, _SMOTE_RATIO = 5, 0.5


def _draw(what: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', '{what}', key, CAST(sample AS VARCHAR))), 1, 8) AS BIGINT)"


def _mix(i: int) -> str:
    return sql_r6(f"s.x{i} + w * (b.x{i} - s.x{i})")


_SMOTE_SQL = (
    f"{P1}, a AS (SELECT concat_ws('|', {E}, CAST({_DAYNO} AS VARCHAR)) AS key, failure, "
    + ", ".join(f"{sql_r6(f'coalesce(CAST({c} AS DOUBLE), 0.0)')} AS x{i}" for i, c in enumerate(_SMOTE)) + " FROM p), "
    "m AS (SELECT DISTINCT key, x0, x1, x2, x3 FROM a WHERE failure = 1), "
    "c AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM a WHERE failure <> 1) AS others), "
    f"t AS (SELECT n, CASE WHEN n > 1 THEN greatest(0, CAST(floor({_SMOTE_RATIO} * others) AS BIGINT) - n) ELSE 0 END AS total FROM c), "
    "d AS (SELECT u.key AS key, v.key AS nkey, " + " + ".join(f"(u.x{i} - v.x{i}) * (u.x{i} - v.x{i})" for i in range(4)) + " AS d2 "
    "FROM m u JOIN m v ON u.key <> v.key), "
    f"k AS (SELECT key, nkey, row_number() OVER (PARTITION BY key ORDER BY d2, nkey) AS rn FROM d QUALIFY rn <= {_SMOTE_K}), "
    "r AS (SELECT m.*, row_number() OVER (ORDER BY md5('42|' || key), key) AS nth FROM m), "
    "e AS (SELECT r.*, t.n, t.total // t.n + CASE WHEN nth <= t.total % t.n THEN 1 ELSE 0 END AS each FROM r, t), "
    "s AS (SELECT key, x0, x1, x2, x3, n, unnest(range(each)) AS sample FROM e), "
    f"g AS (SELECT *, {_draw('n')} % least({_SMOTE_K}, n - 1) + 1 AS pick, {_draw('w')} / 4294967296.0 AS w FROM s) "
    f"SELECT s.key, CAST(s.sample AS INTEGER) AS sample, k.nkey AS neighbour, {sql_r6('w')} AS weight, "
    + ", ".join(f"{_mix(i)} AS {c}" for i, c in enumerate(_SMOTE)) + ", CAST(1 AS INTEGER) AS failure "
    "FROM g s JOIN k ON k.key = s.key AND k.rn = s.pick JOIN m b ON b.key = k.nkey")


@register("smote", _SMOTE_SQL)
def smote(spark, sf_dir):
    """ML16: failure rows filled up to half of the others by interpolation between exact neighbours."""
    p = event_panel(spark, sf_dir).withColumn("_dayno", F.unix_date(F.to_date("timestamp")))
    p = p.select(E, "_dayno", "failure", *[r6(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in _SMOTE])
    return rounded(synthetic.smote(p, [E, "_dayno"], _SMOTE, k=_SMOTE_K, ratio=_SMOTE_RATIO))
