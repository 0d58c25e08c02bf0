"""Learning on batches, compiled models and node tables, early stopping with patience (ML2-4, ML9, ML17, ML19, ML23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r6
from ..operators import ml, online, split, trees
from ..plans.materialize import fresh_dir, written
from ..sinks import write_stats
from ..sources.tables import event_panel
from . import register
from .common import E, P1, TS, rounded, sql_r6
from .models import SMALL_GBT, SMALL_RF, _train_test

_COLS = ["m_purchase", "m_value", "n_events"]
_N, _RATE, _L2 = 5, 1.0, 0.01
_DAY = f"date_diff('day', DATE '1970-01-01', CAST({TS} AS DATE))"


def _online_sql() -> str:
    """The batches one after another, each a one-row table of coefficients."""
    xs = [f"({c} - m{i}) / s{i}" for i, c in enumerate(_COLS)]
    sql = (f"{P1}, d AS (SELECT *, {_DAY} AS day FROM p WHERE m_value IS NOT NULL AND m_purchase IS NOT NULL), "
           "r AS (SELECT (SELECT min(day) FROM d0) AS lo, (SELECT max(day) FROM d0) AS hi), "
           f"b AS (SELECT d.*, least({_N - 1}, (day - lo) * {_N} // (hi - lo + 1)) AS batch FROM d, r), "
           "z AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{i}"
                                       for i, c in enumerate(_COLS)) + " FROM b WHERE batch = 0), "
           "x AS (SELECT batch, failure, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(xs)) + " FROM b, z), "
           "w0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in range(4)) + ")")
    sql = sql.replace(", d AS (", f", d0 AS (SELECT {_DAY} AS day FROM p), d AS (", 1)
    for t in range(_N):
        step = f"CAST({_RATE / (t + 1) ** 0.5!r} AS DOUBLE)"
        err = "(1.0 / (1.0 + exp(-(w3 + w0 * x0 + w1 * x1 + w2 * x2))) - failure)"
        moved = [f"any_value(w{i}) - {step} * (avg({err} * x{i}) + {_L2} * any_value(w{i})) AS w{i}" for i in range(3)]
        sql += f", w{t + 1} AS (SELECT {', '.join(moved)}, any_value(w3) - {step} * avg({err}) AS w3 FROM x, w{t} WHERE batch = {t})"
    rows = [f"SELECT {t} AS step, '{c}' AS name, {sql_r6(f'w{i}')} AS coefficient FROM w{t}"
            for t in range(1, _N + 1) for i, c in enumerate([*_COLS, online.INTERCEPT])]
    return sql + " " + " UNION ALL ".join(rows)


@register("online_logistic", _online_sql())
def online_logistic(spark, sf_dir):
    """ML23: five batches by day, the state saved and loaded between them; coefficients after each."""
    p = event_panel(spark, sf_dir).withColumn("day", F.unix_date(F.to_date("timestamp")))
    p = written(p.select("day", "failure", *_COLS), "batches")
    lo, hi = p.agg(F.min("day"), F.max("day")).first()
    state, base, out = online.Online(tuple(_COLS)), fresh_dir(spark, "online"), []
    for t in range(_N if lo is not None else 0):
        batch = F.least(F.floor((F.col("day") - lo) * _N / F.lit(hi - lo + 1)), F.lit(_N - 1)) == t
        online.save(online.learn(p.filter(batch), state, "failure", _RATE, _L2), spark, f"{base}/{t}")
        state = online.load(spark, f"{base}/{t}")
        out.append(f"{base}/{t}")
    saved = spark.read.schema(online._SCHEMA).parquet(*out) if out else state.frame(spark).limit(0)
    return rounded(saved.select("step", "name", "coefficient"))


# A small ensemble over P1, scored and weighed by the queries below.
_NODES = [
    trees.Node(0, 0, "n_events", 2.5, 1, 2), trees.Node(0, 1, "m_value", 40.0, 3, 4), trees.Node(0, 2, "m_value", 55.0, 5, 6),
    trees.Node(0, 3, prediction=0.05), trees.Node(0, 4, prediction=0.1), trees.Node(0, 5, prediction=0.3), trees.Node(0, 6, prediction=0.45),
    trees.Node(1, 0, "m_value", 48.0, 1, 2), trees.Node(1, 1, prediction=0.12), trees.Node(1, 2, "n_events", 3.5, 3, 4),
    trees.Node(1, 3, prediction=0.2), trees.Node(1, 4, prediction=0.6),
    trees.Node(2, 0, "m_purchase", 60.0, 1, 2), trees.Node(2, 1, prediction=0.18), trees.Node(2, 2, prediction=0.25)]


@register("tree_scores", f"{P1}, q AS (SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value, {sql_r6('m_purchase')} AS m_purchase, n_events FROM p) "
          f"SELECT {E}, {TS}, {sql_r6(trees.score_sql(_NODES))} AS forest, {sql_r6(trees.score_sql(_NODES, True))} AS boosted FROM q")
def tree_scores(spark, sf_dir):
    """ML2/3 scoring: an ensemble as one expression, as a forest and as a boosted sum."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", r6("m_value").alias("m_value"), r6("m_purchase").alias("m_purchase"), "n_events")
    return rounded(p.select(E, "timestamp", trees.score_column(_NODES).alias("forest"), trees.score_column(_NODES, True).alias("boosted")))


def _worth_sql() -> str:
    gini = lambda n, p: f"(2.0 * (CAST({p} AS DOUBLE) / nullif({n}, 0)) * (1.0 - CAST({p} AS DOUBLE) / nullif({n}, 0)))"
    aggs, rows = [], []
    for t, tree in trees._by_tree(_NODES).items():
        for at, path in trees._paths(tree):
            here = " AND ".join(["TRUE", *[f"coalesce({f} <= {th!r}, FALSE)" if left else f"NOT coalesce({f} <= {th!r}, FALSE)" for f, th, left in path]])
            aggs += [f"count(*) FILTER ({here}) AS n_{t}_{at}", f"count(*) FILTER (failure = 1 AND {here}) AS p_{t}_{at}"]
            n = tree[at]
            if n.feature is not None:
                a, lf, rt = f"_{t}_{at}", f"_{t}_{n.left}", f"_{t}_{n.right}"
                gain = (f"{gini('n' + a, 'p' + a)} - (n{lf} * coalesce({gini('n' + lf, 'p' + lf)}, 0) + n{rt} * coalesce({gini('n' + rt, 'p' + rt)}, 0)) / nullif(n{a}, 0)")
                rows.append(f"SELECT {t} AS tree, '{n.feature}' AS feature, coalesce({gain}, 0) * n{a} AS g FROM c")
    return (f"{P1}, q AS (SELECT failure, n_events, {sql_r6('m_value')} AS m_value, {sql_r6('m_purchase')} AS m_purchase FROM p), "
            f"c AS (SELECT {', '.join(aggs)} FROM q), g AS ({' UNION ALL '.join(rows)}), "
            "f AS (SELECT tree, feature, sum(g) AS g FROM g GROUP BY 1, 2), t AS (SELECT tree, sum(g) AS t FROM f GROUP BY 1 HAVING sum(g) > 0), "
            "i AS (SELECT feature, sum(g / t) AS g FROM f JOIN t USING (tree) GROUP BY 1), "
            "k AS (SELECT feature, g / (SELECT sum(g) FROM i) AS importance FROM i) "
            f"SELECT feature, {sql_r6('importance')} AS importance, importance > (SELECT avg(importance) FROM k) AS selected FROM k")


@register("split_importance", _worth_sql())
def split_importance(spark, sf_dir):
    """ML17, ML19, SNK9: importance of an ensemble's features on P1, written, read back, selected above the mean."""
    p = event_panel(spark, sf_dir).select("failure", r6("m_value").alias("m_value"), r6("m_purchase").alias("m_purchase"), "n_events")
    imps = trees.importance(trees.worth(p, _NODES))
    path = fresh_dir(spark, "importances")
    write_stats(imps, path)
    imps = spark.read.schema(imps.schema).parquet(path)
    mean = imps.agg(F.avg("importance")).scalar()
    return rounded(imps.select("feature", "importance", (F.col("importance") > mean).alias("selected")))


_SPLIT_SQL = (f"{P1}, c AS (SELECT {TS} AS t, count(*) AS n FROM p GROUP BY 1), "
              "u AS (SELECT t, sum(n) OVER (ORDER BY t) AS cum, (SELECT count(*) FROM p) AS total FROM c), "
              "k AS (SELECT min(t) AS cut FROM u WHERE cum >= 0.8 * total) ")


@register("compiled_models", _SPLIT_SQL + f"SELECT {E}, {TS}, failure, TRUE AS forest, TRUE AS boosted, TRUE AS logistic FROM p, k WHERE {TS} > cut")
def compiled_models(spark, sf_dir):
    """Fitted models compiled to expressions score the test rows as Spark ML does (within 1e-9): one flag a
    model and row, each TRUE."""
    train, test, feats = _train_test(spark, sf_dir)
    out = test.select(E, "timestamp", "failure", *feats)
    for name, (kind, params) in {"forest": ("rf", SMALL_RF), "boosted": ("gbt", SMALL_GBT), "logistic": ("lr", dict(maxIter=20))}.items():
        model = ml.pipeline(feats, ml.estimator(kind, **params)).fit(train)
        scored = ml.probability(model.transform(out)).withColumn(f"_{name}", F.abs(F.col(ml.PROB) - trees.compiled(model, feats)) < 1e-9)
        out = scored.select(*out.columns, f"_{name}")
    return out.select(E, "timestamp", "failure", *[F.col(f"_{n}").alias(n) for n in ("forest", "boosted", "logistic")])


@register("patience_gbt")
def patience_gbt(spark, sf_dir):
    """ML9: boosting stopped after five rounds without a better validation loss; the loss of every round
    that was fitted, and whether the model keeps the round."""
    train, _, feats = _train_test(spark, sf_dir)
    train = split.hash_split(train.drop("split"), [E, "timestamp"], 0.2)
    model, losses = ml.patient_gbt(train.filter("split = 'train'"), train.filter("split = 'test'"), feats, patience=5, max_iter=64, maxDepth=3)
    kept = model.stages[-1].getNumTrees
    return spark.createDataFrame([(i + 1, float(x), i < kept) for i, x in enumerate(losses)], "round int, loss double, kept boolean")


@register("grid_search_folds")
def grid_search_folds(spark, sf_dir):
    """ML7 at full size: three tree counts by three depths, five folds by key hash; the best mean AUC."""
    train, _, feats = _train_test(spark, sf_dir)
    train = split.fold_column(train.withColumn("_dayno", F.unix_date(F.to_date("timestamp"))), [E, "_dayno"], 5, 42)
    _, best = ml.grid_search(train, feats, "rf", {"numTrees": [5, 10, 20], "maxDepth": [3, 5, 7]}, folds=5, parallelism=4,
                             fold_col="fold", minInstancesPerNode=5, maxBins=32)
    return spark.range(1).select(F.lit(best).alias("best_cv_auc"))
