"""Tree models as tables and expressions (ML2-ML4, ML17, ML19, SRT4).

A fitted ensemble is a table of nodes: (tree, node, feature, threshold, left, right, gain, rows,
prediction, weight), read from the saved model by Spark.  From it follow

* importance, as one aggregation over the nodes;
* scores, as one Spark expression (no model object and no Python where rows are scored) or as SQL
  text for another engine; logistic models likewise;
* what the splits are worth on other data: rows are counted at each node and the impurity that
  each split removes there is summed.

Node tables are as large as the model (2^depth nodes a tree at most), not as the data.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import fresh_dir

NODE = ("tree int, node int, feature string, threshold double, `left` int, `right` int, gain double, rows double, "
        "prediction double, weight double")


@dataclass(frozen=True)
class Node:
    """A split (``feature <= threshold`` goes left) or, without a feature, a leaf."""

    tree: int
    node: int
    feature: str | None = None
    threshold: float | None = None
    left: int = -1
    right: int = -1
    prediction: float = 0.0
    weight: float = 1.0


def node_table(model: PipelineModel, features: list[str], path: str | None = None) -> DataFrame:
    """The nodes of a fitted forest, boosted ensemble or single tree (numeric features).

    ``prediction`` is the probability of class 1 at a forest's node, the value at a boosted one."""
    spark = SparkSession.getActiveSession()
    tree = model.stages[-1]
    path = path or fresh_dir(spark, "nodes")
    tree.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    ensemble = "treeID" in data.columns
    node = F.col("nodeData") if ensemble else F.struct(*data.columns)
    names = F.array(*[F.lit(f) for f in features])
    stats = node["impurityStats"]
    regression = "GBT" in type(tree).__name__
    # a class-count vector for forests; (weight sum, sum, sum of squares) for boosted trees
    total = F.element_at(stats, 1) if regression else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value = node["prediction"] if regression else F.coalesce(F.get(stats, F.lit(1)) / total, F.lit(0.0))
    index = node["split"]["featureIndex"]
    out = data.select(
        (F.col("treeID") if ensemble else F.lit(0)).cast("int").alias("tree"), node["id"].alias("node"),
        F.when(index >= 0, F.get(names, index)).alias("feature"),
        F.when(index >= 0, F.element_at(node["split"]["leftCategoriesOrThreshold"], 1)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["gain"].alias("gain"),
        total.alias("rows"), value.alias("prediction"))
    weights = tree.treeWeights if ensemble else [1.0]
    return out.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree")))


def importance(nodes: DataFrame, per_tree: bool = True) -> DataFrame:
    """(feature, importance): gain times rows summed over the splits of a feature; with ``per_tree``
    each tree counts alike (forests), else by its gains (boosting).  Sums to 1."""
    by = nodes.filter(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    if per_tree:
        total = by.groupBy("tree").agg(F.sum("g").alias("t")).filter("t > 0")
        by = by.join(total, "tree").withColumn("g", F.col("g") / F.col("t"))
    one = by.groupBy("feature").agg(F.sum("g").alias("g"))
    return one.select("feature", (F.col("g") / F.lit(one.agg(F.sum("g")).first()[0] or 1.0)).alias("importance"))


def nodes_of(table: DataFrame) -> list[Node]:
    """The nodes on the driver (a model's worth of rows)."""
    return [Node(r["tree"], r["node"], r["feature"], r["threshold"], r["left"], r["right"], r["prediction"], r["weight"])
            for r in table.select("tree", "node", "feature", "threshold", "left", "right", "prediction", "weight").collect()]


def _by_tree(nodes: list[Node]) -> dict[int, dict[int, Node]]:
    out: dict[int, dict[int, Node]] = defaultdict(dict)
    for n in nodes:
        out[n.tree][n.node] = n
    return dict(sorted(out.items()))


def _tree_column(tree: dict[int, Node], at: int) -> Column:
    n = tree[at]
    if n.feature is None:
        return F.lit(n.prediction)
    # a missing value fails the comparison and goes right, as NaN does in Spark ML
    go = F.coalesce(F.col(n.feature).cast("double") <= F.lit(n.threshold), F.lit(False))
    return F.when(go, _tree_column(tree, n.left)).otherwise(_tree_column(tree, n.right))


def score_column(nodes: list[Node], boosted: bool = False) -> Column:
    """Probability of class 1: the mean of a forest's leaves, or the logistic of twice a boosted sum."""
    total = F.lit(0.0)
    trees = _by_tree(nodes)
    for t in trees.values():
        total = total + F.lit(t[0].weight) * _tree_column(t, 0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total)) if boosted else total / F.lit(float(len(trees)))


def _tree_sql(tree: dict[int, Node], at: int) -> str:
    n = tree[at]
    if n.feature is None:
        return f"CAST({n.prediction!r} AS DOUBLE)"
    return (f"CASE WHEN {n.feature} <= CAST({n.threshold!r} AS DOUBLE) THEN {_tree_sql(tree, n.left)} "
            f"ELSE {_tree_sql(tree, n.right)} END")


def score_sql(nodes: list[Node], boosted: bool = False) -> str:
    """The same as SQL text."""
    trees = _by_tree(nodes)
    total = " + ".join(["CAST(0.0 AS DOUBLE)", *[f"CAST({t[0].weight!r} AS DOUBLE) * ({_tree_sql(t, 0)})" for t in trees.values()]])
    return f"(1.0 / (1.0 + exp(-2.0 * ({total}))))" if boosted else f"(({total}) / {float(len(trees))!r})"


def logistic_column(coefficients: dict[str, float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for c, w in coefficients.items():
        z = z + F.lit(float(w)) * F.col(c).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logistic_sql(coefficients: dict[str, float], intercept: float) -> str:
    z = " + ".join([f"CAST({float(intercept)!r} AS DOUBLE)", *[f"CAST({float(w)!r} AS DOUBLE) * {c}" for c, w in coefficients.items()]])
    return f"(1.0 / (1.0 + exp(-({z}))))"


def compiled(model: PipelineModel, features: list[str]) -> Column:
    """The probability of class 1 of a fitted pipeline (assembler and a tree or logistic model) as one expression."""
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        return logistic_column(dict(zip(features, last.coefficients.toArray().tolist())), last.intercept)
    return score_column(nodes_of(node_table(model, features)), "GBT" in type(last).__name__)


def _paths(tree: dict[int, Node], at: int = 0, path: tuple = ()) -> list[tuple[int, tuple]]:
    """(node, conditions on the way) of every node."""
    n = tree[at]
    out = [(at, path)]
    if n.feature is not None:
        out += _paths(tree, n.left, (*path, (n.feature, n.threshold, True)))
        out += _paths(tree, n.right, (*path, (n.feature, n.threshold, False)))
    return out


def worth(df: DataFrame, nodes: list[Node], label: str = "failure") -> DataFrame:
    """(tree, node, feature, rows, gain): the Gini impurity that each split removes on the labelled rows
    of ``df``.  All nodes are counted in one aggregation over the data (two numbers a node)."""
    trees = _by_tree(nodes)
    aggs, names = [], []
    for t, tree in trees.items():
        for at, path in _paths(tree):
            here = F.lit(True)
            for feature, threshold, left in path:
                go = F.coalesce(F.col(feature).cast("double") <= F.lit(threshold), F.lit(False))
                here = here & (go if left else ~go)
            names.append((t, at))
            aggs += [F.count_if(here).alias(f"n_{t}_{at}"), F.count_if(here & (F.col(label) == 1)).alias(f"p_{t}_{at}")]
    r = df.filter(F.col(label).isNotNull()).agg(*aggs).first()
    gini = lambda n, p: 2.0 * (p / n) * (1.0 - p / n) if n else 0.0
    rows = []
    for t, at in names:
        n = trees[t][at]
        if n.feature is None:
            continue
        total, ((ln, lp), (rn, rp)) = r[f"n_{t}_{at}"], [(r[f"n_{t}_{c}"], r[f"p_{t}_{c}"]) for c in (n.left, n.right)]
        gain = gini(total, r[f"p_{t}_{at}"]) - (ln * gini(ln, lp) + rn * gini(rn, rp)) / total if total else 0.0
        rows.append((t, at, n.feature, n.threshold, n.left, n.right, gain, float(total), n.prediction, n.weight))
    return df.sparkSession.createDataFrame(rows, NODE)
