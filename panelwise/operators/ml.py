"""Model training, search, weighting and scoring on Spark ML (ML1-9, ML15-17, ML19-21).

Every fit is a distributed Spark ML job; the driver only loops over a handful of
candidate estimators or parameter maps.  Preprocessing (assembly, optional scaling)
lives in one ``Pipeline`` so the saved model carries it (S15, S22).
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import band
from ..plans.broadcast import bounded
from .report import class_weights
from .split import key_hash

FEATURES, PROB = "features", "p1"

# Reference estimator settings.
RF_DEFAULT = dict(numTrees=200, maxDepth=10, maxBins=128, minInstancesPerNode=20, featureSubsetStrategy="sqrt")
GBT_DEFAULT = dict(maxIter=100, maxDepth=10)
LR_DEFAULT = dict(maxIter=100, regParam=0.1, elasticNetParam=0.5)
# Our own bounds of the boosting search (min, max) per Spark parameter.
SEARCH_BOUNDS = {"maxDepth": (3, 10), "stepSize": (0.01, 0.3), "subsamplingRate": (0.5, 1.0),
                 "featureSubsetStrategy": (0.5, 1.0), "minInstancesPerNode": (1, 50),
                 "minInfoGain": (0.0, 0.5), "maxBins": (16, 128), "maxIter": (20, 100)}


def assembler(features: list[str], handle_invalid: str = "keep") -> VectorAssembler:
    """ML1: one vector column; NULL/NaN handling per ``handle_invalid`` ('keep'/'skip'/'error')."""
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid=handle_invalid)


def estimator(kind: str, label: str = "failure", weight_col: str | None = None, seed: int = 42, **params):
    """ML2-4: 'rf', 'gbt' or 'lr' with the reference defaults, overridable."""
    common = dict(featuresCol=FEATURES, labelCol=label)
    if weight_col:
        common["weightCol"] = weight_col
    if kind == "rf":
        return RandomForestClassifier(seed=seed, **common, **{**RF_DEFAULT, **params})
    if kind == "gbt":
        return GBTClassifier(seed=seed, **common, **{**GBT_DEFAULT, **params})
    if kind == "lr":
        return LogisticRegression(**common, **{**LR_DEFAULT, **params})
    raise ValueError(f"unknown model kind {kind!r}; expected 'rf', 'gbt' or 'lr'")


def pipeline(features: list[str], est, scale: bool = False) -> Pipeline:
    stages = [assembler(features)]
    if scale:
        stages.append(StandardScaler(inputCol=FEATURES, outputCol="_scaled", withMean=True, withStd=True))
        est = est.copy().setFeaturesCol("_scaled")
    return Pipeline(stages=stages + [est])


def probability(df: DataFrame) -> DataFrame:
    """Probability of class 1 as a plain double column."""
    return df.withColumn(PROB, vector_to_array("probability")[1])


def evaluator(label: str = "failure", metric: str = "areaUnderROC") -> BinaryClassificationEvaluator:
    """ML10 on the raw score (S12: not on hard predictions)."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName=metric)


def fit_best(train: DataFrame, test: DataFrame, features: list[str], kinds: dict[str, dict],
             label: str = "failure", weight_col: str | None = None):
    """ML5: fit each candidate, evaluate AUC on ``test``, keep the best.
    Returns (best_model, metrics DataFrame(model, auc))."""
    results, models = [], {}
    ev = evaluator(label)
    for name, params in kinds.items():
        model = pipeline(features, estimator(name, label, weight_col, **params)).fit(train)
        models[name] = model
        results.append((name, float(ev.evaluate(model.transform(test)))))
    best = max(results, key=lambda r: r[1])[0]
    spark = train.sparkSession
    return models[best], spark.createDataFrame(results, "model string, auc double")


def soft_vote(models: dict[str, PipelineModel], df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """ML6: mean probability over models and majority of hard votes, per row of ``df``.  The
    models are chained over one frame: no join, and keys need not be unique or non-null."""
    out = df
    probs, votes = [], []
    for name, m in models.items():
        s = probability(m.transform(out)).withColumn(f"_v_{name}", F.col("prediction").cast("int"))
        out = s.select(*out.columns, F.col(PROB).alias(f"_p_{name}"), f"_v_{name}")
        probs.append(F.col(f"_p_{name}"))
        votes.append(F.col(f"_v_{name}"))
    mean = sum(probs[1:], probs[0]) / len(probs)
    vote = (sum(votes[1:], votes[0]) * 2 > len(votes)).cast("int")
    return out.select(*keys, mean.alias("soft_probability"), (mean > threshold).cast("int").alias("soft_prediction"),
                      vote.alias("majority_vote"))


def grid_search(train: DataFrame, features: list[str], kind: str = "rf", grid: dict | None = None,
                folds: int = 5, parallelism: int = 4, label: str = "failure", fold_col: str | None = None,
                **params):
    """ML7: ``CrossValidator`` over a parameter grid; reports the best mean AUC.  The vectors are assembled
    before the folds are cached, so once a fold and not once for each pass of each fit."""
    est = estimator(kind, label, **params)
    vectors = assembler(features)
    weight = [est.getWeightCol()] if est.isSet("weightCol") else []
    rows = vectors.transform(train).select(FEATURES, label, *weight, *([fold_col] if fold_col else []))
    builder = ParamGridBuilder()
    for name, values in (grid or {"numTrees": [10, 20], "maxDepth": [3, 5]}).items():
        builder = builder.addGrid(est.getParam(name), values)
    cv = CrossValidator(estimator=est, estimatorParamMaps=builder.build(), evaluator=evaluator(label),
                        numFolds=folds, parallelism=parallelism, seed=42)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    model = cv.fit(rows)
    return PipelineModel([vectors, model.bestModel]), max(model.avgMetrics)


def random_search(train: DataFrame, features: list[str], n: int = 10, seed: int = 42, parallelism: int = 4,
                  label: str = "failure", bounds: dict | None = None, train_ratio: float = 0.8, **fixed):
    """ML8 re-aimed: ``n`` seeded random parameter maps for ``GBTClassifier`` inside
    ``TrainValidationSplit``; the maps are fitted in parallel."""
    est = estimator("gbt", label, **fixed)
    pipe = pipeline(features, est)
    rng = random.Random(seed)
    b = bounds or SEARCH_BOUNDS
    maps = []
    for _ in range(n):
        m = {}
        for name, (lo, hi) in b.items():
            if name in fixed:
                continue
            if name == "featureSubsetStrategy":
                m[est.getParam(name)] = f"{rng.uniform(lo, hi):.2f}"
            elif isinstance(lo, int) and isinstance(hi, int):
                m[est.getParam(name)] = rng.randint(lo, hi)
            else:
                m[est.getParam(name)] = rng.uniform(lo, hi)
        maps.append(m)
    tvs = TrainValidationSplit(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator(label),
                               trainRatio=train_ratio, parallelism=parallelism, seed=seed)
    model = tvs.fit(train)
    return model.bestModel, max(model.validationMetrics)


def early_stop_gbt(df: DataFrame, features: list[str], valid_col: str, label: str = "failure",
                   max_iter: int = 1000, tol: float = 0.01, **params) -> PipelineModel:
    """ML9 re-aimed: boosting stops when the validation error stops improving by ``tol``."""
    est = estimator("gbt", label, maxIter=max_iter, validationIndicatorCol=valid_col, validationTol=tol, **params)
    return pipeline(features, est).fit(df)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(best round from 1, whether ``patience`` rounds after it were no better)."""
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    for i in range(len(losses)):  # the first round that stands for ``patience`` rounds decides
        if min(losses[:i + 1]) == losses[i] and len(losses) > i + patience and min(losses[i + 1:i + 1 + patience]) >= losses[i]:
            return losses.index(min(losses[:i + 1])) + 1, True
    return best + 1, False


def cut_ensemble(model: PipelineModel, rounds: int) -> PipelineModel:
    """A boosted pipeline with its first ``rounds`` trees only."""
    last = model.stages[-1]
    sc = SparkSession.getActiveSession().sparkContext
    java, gateway = last._java_obj, sc._gateway
    trees = gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], float(java.treeWeights()[i])
    short = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), java.numClasses())
    out = GBTClassificationModel(short)
    for p in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        short.set(short.getParam(p), last.getOrDefault(p))
    out._resetUid(java.uid())
    out._transfer_params_from_java()
    return PipelineModel([*model.stages[:-1], out])


def patient_gbt(train: DataFrame, valid: DataFrame, features: list[str], label: str = "failure", patience: int = 50,
                max_iter: int = 1000, first: int = 16, **params) -> tuple[PipelineModel, list[float]]:
    """ML9: boosting stops once ``patience`` rounds after the best one have not lowered the loss on the
    ``valid`` rows, and the model is cut at that round.  Returns it and the loss of each round fitted.

    Rounds are fitted 16, 64, 256, ... at a time (the seed makes the first ones the same each time) and
    judged at 16, 32, 64, ...: the rounds fitted before the last fit add at most a third to it.  The
    losses are Spark's own per-round evaluation, one pass over the validation rows."""
    rounds = upto = min(first, max_iter)
    while True:
        model = pipeline(features, estimator("gbt", label, **{**params, "maxIter": rounds})).fit(train)
        losses = list(model.stages[-1].evaluateEachIteration(PipelineModel(model.stages[:-1]).transform(valid)))
        while upto <= rounds:
            best, settled = best_round(losses[:upto], patience)
            if settled or upto >= max_iter:
                return cut_ensemble(model, best), losses[:upto]
            upto = min(2 * upto, max_iter)
        rounds = min(4 * rounds, max_iter)


def with_class_weights(df: DataFrame, label: str = "failure", name: str = "class_weight") -> DataFrame:
    """ML15: weight column ``N / (K n_k)`` joined by label (K rows, size checked).  Unlabelled
    rows are kept with weight 1 and do not count towards N or K."""
    known = df.filter(F.col(label).isNotNull())
    w, _ = bounded(class_weights(known, label).select(label, F.col("class_weight").alias(name)), 10_000)
    return df.join(w, label, "left").withColumn(name, F.coalesce(name, F.lit(1.0)))


def undersample(df: DataFrame, keys: list[str], label: str = "failure", ratio: float = 1.0,
                seed: int = 42) -> DataFrame:
    """ML16: keep all positives and about ``ratio`` negatives per positive.

    Negatives are kept by a hash of their key, not by a random draw, so a recomputed
    partition (lost executor) keeps exactly the same rows.  Unlabelled rows are neither and
    all stay."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    frac = 1.0 if neg == 0 else min(1.0, ratio * pos / neg)
    h = F.conv(F.substring(key_hash(keys, seed), 1, 8), 16, 10).cast("long")
    return df.filter((F.col(label) == 1) | F.col(label).isNull() | (h < F.lit(int(frac * 16 ** 8))))


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """ML17: (feature, importance, rank) of a tree model, highest first."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    # one row per feature (a few hundred at most): a single-partition rank is fine
    df = spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def select_by_importance(imps: DataFrame) -> DataFrame:
    """ML19: features whose importance is above the mean importance."""
    mean = imps.agg(F.avg("importance")).scalar()
    return imps.filter(F.col("importance") > mean)


def retrain_window(features: DataFrame, time_col: str, start, feature_cols: list[str], kind: str = "lr",
                   label: str = "failure", **params) -> PipelineModel:
    """ML23: refit on the readings since ``start`` (a sliding window of partitions when
    ``features`` comes from ``sources.readers.read_features``)."""
    train = features.filter(F.col(time_col) >= start)
    return pipeline(feature_cols, estimator(kind, label, **params)).fit(train)


def score(model: PipelineModel, df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """ML20: probability, decision ``p > t`` and risk band for every row."""
    s = probability(model.transform(df))
    return s.select(*keys, F.col(PROB).alias("failure_probability"),
                    (F.col(PROB) > threshold).cast("int").alias("prediction"), band(PROB).alias("risk_level"))
