"""Quantiles from mergeable sketches (AGG9, approximate path): one KLL sketch a day and measure.

A day's sketch is made once, in one aggregation with map-side combine, and is a few kilobytes however
many rows the day has.  Any window is the merge of its days' sketches, without its rows.  A sketch
with parameter k answers a rank within about 1.65 / k (99 %, one rank), the merge of many the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import PanelSpec

K = 400


def rank_error(k: int = K) -> float:
    """Normalised rank error that 99 % of single rank queries stay within (KLL's own bound)."""
    return 2.296 / k ** 0.9021


def daily(df: DataFrame, spec: PanelSpec, measures: list[str], k: int = K) -> DataFrame:
    """(day, measure, sketch, n); NULL and NaN values are not counted."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("_s")
    long = df.select(F.to_date(spec.time).alias("day"), one).select("day", "_s.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("day", "measure").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def window(sketches: DataFrame, first, last, k: int = K) -> DataFrame:
    """(measure, sketch, n) of the days ``first .. last``, merged."""
    days = sketches.filter(F.col("day").between(first, last))
    return days.groupBy("measure").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(merged: DataFrame, qs: list[float]) -> DataFrame:
    """(measure, q, value) of merged sketches."""
    one = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value"))
                              for q in qs])).alias("_s")
    return merged.select("measure", "n", one).select("measure", "_s.q", "_s.value", "n")


def robust_stats(merged: DataFrame, cols: list[str]) -> DataFrame:
    """Median and IQR of each column, as ``scale.fit_robust`` names them, from merged sketches."""
    long = quantiles(merged, [0.25, 0.5, 0.75])
    wide = long.agg(*[F.max(F.when((F.col("measure") == c) & (F.col("q") == q), F.col("value"))).alias(f"{n}__{c}")
                      for c in cols for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))])
    out = []
    for c in cols:
        iqr = F.col(f"p75__{c}") - F.col(f"p25__{c}")
        out += [F.coalesce(f"median__{c}", F.lit(0.0)).alias(f"median__{c}"),
                F.when(iqr.isNull() | (iqr <= 0), F.lit(1.0)).otherwise(iqr).alias(f"iqr__{c}")]
    return wide.select(*out)
