"""Classifier evaluation from scored rows (ML10-14, ML18): all reductions are aggregations.

Every metric comes from a handful of counts, so a 100 TB scored table costs one
aggregation pass; AUC is exact (rank form with ties averaged) through a
range-partitioned running count over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import running_totals

# Threshold grid of the search, 0.10 to 0.85 in steps of 0.05.
THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(16))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "failure", prediction: str = "prediction") -> DataFrame:
    return (df.groupBy(F.col(label).cast("int").alias("actual"),
                       F.col(prediction).cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def metrics(df: DataFrame, label: str = "failure", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall and F1 of class 1 (G1), label-weighted F1 (G2/G3)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec1, rec1 = _div(tp, tp + fp), _div(tp, tp + fn)
    prec0, rec0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1_1 = _div(2 * prec1 * rec1, prec1 + rec1)
    f1_0 = _div(2 * prec0 * rec0, prec0 + rec0)
    return c.select("tp", "fp", "fn", "tn", _div(tp + tn, n).alias("accuracy"),
                    prec1.alias("precision"), rec1.alias("recall"), f1_1.alias("f1_positive"),
                    _div(f1_1 * (tp + fn) + f1_0 * (tn + fp), n).alias("f1_weighted"))


def class_report(df: DataFrame, label: str = "failure", prediction: str = "prediction") -> DataFrame:
    """ML14: per class precision, recall, F1 and support."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    one = [F.struct(F.lit(k).alias("cls"), F.count_if((y == k) & (p == k)).alias("tp"), F.count_if(p == k).alias("predicted"),
                    F.count_if(y == k).alias("support")) for k in (0, 1)]
    c = df.agg(F.array(*one).alias("r")).select(F.explode("r").alias("r")).select("r.*")  # one wide pass, then two rows
    prec, rec = _div(F.col("tp"), F.col("predicted")), _div(F.col("tp"), F.col("support"))
    return c.select("cls", prec.alias("precision"), rec.alias("recall"),
                    _div(2 * prec * rec, prec + rec).alias("f1"), "support")


def auc(df: DataFrame, label: str = "failure", score: str = "score") -> DataFrame:
    """ML10: exact ROC AUC = P(score_pos > score_neg) + 0.5 P(tie).  Rows whose score is NULL or
    NaN have no rank and are left out, as are unlabelled rows."""
    y = F.col(label).cast("int")
    per = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(F.col(score).alias("_s")).agg(F.count_if(y == 1).alias("_pos"),
                                                   F.count_if(y == 0).alias("_neg"))
    cum = running_totals(per, ["_s"], {"_cneg": F.col("_neg")})
    below = F.col("_cneg") - F.col("_neg")
    return cum.agg(_div(F.sum(F.col("_pos") * (below + 0.5 * F.col("_neg"))),
                        F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))


def threshold_search(df: DataFrame, label: str = "failure", score: str = "score",
                     thresholds=THRESHOLDS) -> DataFrame:
    """ML18: confusion counts at each threshold (decision ``score >= t``), precision,
    recall, F1, and ``best`` on the first threshold with the highest F1 (S13, S17).

    One pass: each row falls into the bucket of the highest threshold it reaches;
    counts at t_i are sums over buckets >= i (16 rows).
    """
    y = F.col(label).cast("int")
    s = F.col(score)
    bucket = F.lit(-1)
    for i, t in enumerate(thresholds):
        bucket = F.when(s >= F.lit(float(t)), F.lit(i)).otherwise(bucket)
    agg = df.groupBy(bucket.alias("_b")).agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    totals = [F.sum(F.when(F.col("_b") >= i, F.col("_pos")).otherwise(0)).alias(f"tp{i}") for i in range(len(thresholds))]
    totals += [F.sum(F.when(F.col("_b") >= i, F.col("_neg")).otherwise(0)).alias(f"fp{i}") for i in range(len(thresholds))]
    totals.append(F.sum("_pos").alias("P"))
    wide = agg.agg(*totals)
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                     (F.col("P") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)]
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tp, fp, fn = (F.col(k).cast("long") for k in ("tp", "fp", "fn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    out = long.select("threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), prec.alias("precision"),
                      rec.alias("recall"), _div(2 * prec * rec, prec + rec).alias("f1"))
    best = out.select(F.struct(F.max("f1").alias("f1")).alias("b")).scalar()
    first = out.filter(F.col("f1") == best["f1"]).select(F.min("threshold")).scalar()
    return out.withColumn("best", F.col("threshold") == first)
