"""Saved statistics for increments (STR1): what features need of a whole history, kept mergeable.

The state of some rows is their value counts: (entity, measure, value, n).  States of disjoint rows
merge by adding the counts, in any order and grouping, so every increment adds its own and none is
read twice.  From a state follow, exactly, the per-entity quantiles behind spike counts, and the
means, deviations, quantiles and extremes behind clipping and scaling.

The counts are aggregated by value, so an entity with a third of all rows is spread over its values,
and a value with a third of all rows is one line after the partial aggregation.  NULL and NaN values
are missing and are not counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..operators.features import THR
from ..operators.quality import SIGMA
from ..plans.ranks import group_quantiles
from ..spec import PanelSpec

MEASURE, VALUE, N = "measure", "value", "n"


def state_of(rows: DataFrame, spec: PanelSpec, measures: list[str] | None = None) -> DataFrame:
    """(entity, measure, value, n) of the rows."""
    measures = spec.present(rows) if measures is None else measures
    one = F.explode(F.array(*[F.struct(F.lit(m).alias(MEASURE), F.col(m).cast("double").alias(VALUE)) for m in measures])).alias("_s")
    long = rows.select(spec.entity, one).select(spec.entity, "_s.*").filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    return long.groupBy(spec.entity, MEASURE, VALUE).agg(F.count(F.lit(1)).alias(N))


def merged(spec: PanelSpec, *states: DataFrame) -> DataFrame:
    """The state of all rows together."""
    whole = reduce(DataFrame.unionByName, states)
    return whole.groupBy(spec.entity, MEASURE, VALUE).agg(F.sum(N).alias(N))


def thresholds(state: DataFrame, spec: PanelSpec, measures: list[str], q: float) -> DataFrame:
    """Per entity the q-quantile of each measure over all its rows (one column a measure)."""
    mine = state.filter(F.col(MEASURE).isin(*measures))
    long = group_quantiles(mine, [spec.entity, MEASURE], VALUE, {"_q": q}, weight=N)
    wide = long.groupBy(spec.entity).agg(*[F.max(F.when(F.col(MEASURE) == m, F.col("_q"))).alias(THR + m) for m in measures])
    return wide


def moments(state: DataFrame, cols: list[str], names: tuple[str, str] = ("mean", "std")) -> DataFrame:
    """One row: mean and sample deviation of each measure over all rows (NULL without values)."""
    per = state.groupBy(MEASURE).agg((F.sum(F.col(VALUE) * F.col(N)) / F.sum(N)).alias("_mean"), F.sum(N).alias("_all"))
    far = state.join(F.broadcast(per), MEASURE)  # one row a measure
    dev = far.groupBy(MEASURE, "_mean", "_all").agg(F.sum(F.col(N) * (F.col(VALUE) - F.col("_mean")) ** 2).alias("_m2"))
    std = F.when(F.col("_all") > 1, F.sqrt(F.col("_m2") / (F.col("_all") - 1)))
    return dev.select(MEASURE, "_mean", std.alias("_std")).agg(*[
        F.max(F.when(F.col(MEASURE) == c, F.col(x))).alias(f"{n}__{c}") for c in cols for n, x in zip(names, ("_mean", "_std"))])


def zscore_stats(state: DataFrame, cols: list[str]) -> DataFrame:
    """What ``scale.fit_zscore`` gives on all rows."""
    return moments(state, cols).select(*[x for c in cols for x in (
        F.coalesce(f"mean__{c}", F.lit(0.0)).alias(f"mean__{c}"),
        F.when(F.col(f"std__{c}").isNull() | (F.col(f"std__{c}") == 0), F.lit(1.0)).otherwise(F.col(f"std__{c}")).alias(f"std__{c}"))])


def robust_stats(state: DataFrame, cols: list[str]) -> DataFrame:
    """What ``scale.fit_robust`` gives on all rows."""
    long = group_quantiles(state, [MEASURE], VALUE, {"p25": 0.25, "median": 0.5, "p75": 0.75}, weight=N)
    wide = long.agg(*[F.max(F.when(F.col(MEASURE) == c, F.col(n))).alias(f"{n}__{c}") for c in cols for n in ("p25", "median", "p75")])
    out = []
    for c in cols:
        iqr = F.col(f"p75__{c}") - F.col(f"p25__{c}")
        out += [F.coalesce(f"median__{c}", F.lit(0.0)).alias(f"median__{c}"),
                F.when(iqr.isNull() | (iqr <= 0), F.lit(1.0)).otherwise(iqr).alias(f"iqr__{c}")]
    return wide.select(*out)


def minmax_stats(state: DataFrame, cols: list[str]) -> DataFrame:
    """What ``scale.fit_minmax`` gives on all rows."""
    return state.agg(*[f(F.when(F.col(MEASURE) == c, F.col(VALUE))).alias(f"{n}__{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def clipped(rows: DataFrame, state: DataFrame, cols: list[str], k: float = SIGMA) -> DataFrame:
    """``clean.clip_outliers`` of new rows with the bounds of all rows of the state."""
    m = moments(state, cols).first()  # one row
    out = {}
    for c in cols:
        mean, std = m[f"mean__{c}"] or 0.0, m[f"std__{c}"] or 0.0
        out[c] = clip(F.col(c), F.lit(mean - k * std), F.lit(mean + k * std)).alias(c)
    return rows.select(*[out.get(c, F.col(c)) for c in rows.columns])
