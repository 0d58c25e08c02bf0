"""Per-entity window features: rolling stats, deltas, lags, trends, slope, spike counts.

Every feature family is a ``FeatureGroup`` (column builders + how far back it reads).
``add_features`` lays the panel out once (``plans.segments``) and evaluates every group
in one projection, so all families share a single exchange on the entity key.
Absent values (no row ``w`` back, empty frame, one-row std) become 0, as the
reference's ``fillna(0)`` does for computed columns; input columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_number
from ..plans.joins import join_nullsafe
from ..plans.ranks import group_quantiles
from ..plans.segments import Layout, hot_entities, layout
from ..spec import PanelSpec
from .clean import nan_as_null

def _zero() -> Column:
    return F.lit(0.0)


STATS = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
RN, DAYCOL, THR = "_rn", "_dayno", "_thr_"


@dataclass
class FeatureGroup:
    build: Callable[[str, Column, Layout, Window], list[Column]]
    lookback: int = 0
    lookback_days: int = 0
    needs_rn: bool = False
    spike_q: float | None = None


def _rows(w: Window, n: int) -> Window:
    return w.rowsBetween(-(n - 1), 0)


def rolling(stats=("mean", "max", "min", "std"), windows=(7, 14, 30)) -> FeatureGroup:
    """WIN1-4: ``{m}_{stat}_{w}d`` over the last w rows (current included)."""
    def build(m, x, lay, w):
        return [F.coalesce(STATS[s](x).over(_rows(w, n)), _zero()).alias(f"{m}_{s}_{n}d")
                for n in windows for s in stats]
    return FeatureGroup(build, lookback=max(windows) - 1)


def rolling_days(stats=("mean",), windows=(7,)) -> FeatureGroup:
    """Calendar frame: rows whose day lies in [day - (w-1), day] (peers included)."""
    def build(m, x, lay, w):
        dw = Window.partitionBy(*lay.part).orderBy(DAYCOL)
        return [F.coalesce(STATS[s](x).over(dw.rangeBetween(-(n - 1), 0)), _zero())
                .alias(f"{m}_{s}_{n}days") for n in windows for s in stats]
    return FeatureGroup(build, lookback_days=max(windows) - 1)


def deltas(windows=(7, 14, 30)) -> FeatureGroup:
    """WIN5: ``x - x[t - w rows]``."""
    def build(m, x, lay, w):
        return [F.coalesce(x - F.lag(x, n).over(w), _zero()).alias(f"{m}_delta_{n}d") for n in windows]
    return FeatureGroup(build, lookback=max(windows))


def lags(ks=(1, 3, 7)) -> FeatureGroup:
    """WIN7: ``x[t - k rows]``."""
    def build(m, x, lay, w):
        return [F.coalesce(F.lag(x, k).over(w), _zero()).alias(f"{m}_lag_{k}d") for k in ks]
    return FeatureGroup(build, lookback=max(ks))


def trends(spans=(7, 14)) -> FeatureGroup:
    """WIN8: two-point trend ``(x - x[t - s rows]) / s``."""
    def build(m, x, lay, w):
        return [F.coalesce((x - F.lag(x, s).over(w)) / F.lit(float(s)), _zero()).alias(f"{m}_trend_{s}d")
                for s in spans]
    return FeatureGroup(build, lookback=max(spans))


def slope(rows: int = 7, min_rows: int = 3) -> FeatureGroup:
    """WIN9: least-squares slope of x on row position over the last ``rows`` rows,
    0 until ``min_rows`` non-null values are in the frame."""
    def build(m, x, lay, w):
        f = _rows(w, rows)
        return [F.when(F.count(x).over(f) >= min_rows,
                       F.coalesce(F.regr_slope(x, F.col(RN).cast("double")).over(f), _zero()))
                .otherwise(_zero()).alias(f"{m}_slope_{rows}d")]
    return FeatureGroup(build, lookback=rows - 1, needs_rn=True)


def spikes(windows=(7, 14, 30), q: float = 0.9) -> FeatureGroup:
    """WIN6: rows in the last w whose value exceeds the entity's q-quantile (over its whole
    history, exact ``quantile_cont``); 0 until w rows exist."""
    def build(m, x, lay, w):
        thr = F.col(THR + m)
        hit = F.when(x > thr, 1).otherwise(0)
        return [F.when(F.count(F.lit(1)).over(_rows(w, n)) >= n,
                       F.sum(hit).over(_rows(w, n)).cast("double")).otherwise(_zero())
                .alias(f"{m}_spike_{n}d") for n in windows]
    return FeatureGroup(build, lookback=max(windows) - 1, spike_q=q)


def default_groups(spec: PanelSpec, *, spike: bool = True, with_slope: bool = True) -> list[FeatureGroup]:
    g = [rolling(windows=spec.windows), deltas(spec.windows), lags(spec.lags), trends(spec.trend_spans)]
    if spike:
        g.append(spikes(spec.windows, spec.spike_quantile))
    if with_slope:
        g.append(slope(spec.slope_rows, spec.slope_min_rows))
    return g


def entity_thresholds(df: DataFrame, spec: PanelSpec, measures: list[str], q: float,
                      hot: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Exact per-entity q-quantile (linear interpolation) of each measure (AGG10).

    Entities up to ``spec.hot_rows`` rows use Spark's exact ``percentile`` in one
    aggregation for all measures (its per-group buffer holds at most ``hot_rows``
    values).  Hot entities (``hot``, from ``hot_entities``) go through the bucketed rank
    path of ``plans.ranks``, which spreads one entity over many tasks.
    """
    names = names or {m: THR + m for m in measures}
    df = nan_as_null(df, measures)  # S3: NaN counts as missing on both paths
    keys = hot.select(spec.entity) if hot is not None else None
    cold = df if keys is None else join_nullsafe(df, keys, [spec.entity], "left_anti")
    out = cold.groupBy(spec.entity).agg(*[F.percentile(F.col(m).cast("double"), q).alias(names[m])
                                          for m in measures])
    if keys is None:
        return out
    heavy = join_nullsafe(df, keys, [spec.entity], "left_semi")
    stacked = heavy.select(spec.entity, F.explode(F.array(*[
        F.struct(F.lit(m).alias("_m"), F.col(m).cast("double").alias("_x")) for m in measures])).alias("_s"))
    stacked = stacked.select(spec.entity, "_s._m", "_s._x")
    long = group_quantiles(stacked, [spec.entity, "_m"], "_x", {"_q": q})
    wide = long.groupBy(spec.entity).agg(*[F.max(F.when(F.col("_m") == m, F.col("_q"))).alias(names[m])
                                           for m in measures])
    # hot entities whose values are all NULL still get a row (NULL thresholds)
    wide = join_nullsafe(heavy.select(spec.entity).distinct(), wide, [spec.entity], "left")
    return out.unionByName(wide)


def add_features(df: DataFrame, spec: PanelSpec, groups: list[FeatureGroup],
                 measures: list[str] | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """Append the columns of every group for every measure present in ``df``.  Spike thresholds may be
    given (entity and one column a measure); else they are those of ``df``."""
    measures = spec.present(df) if measures is None else measures
    df = nan_as_null(df, measures)  # S3: the result must not depend on the path taken
    lookback = max([g.lookback for g in groups] + [0])
    lookback_days = max([g.lookback_days for g in groups] + [0])
    base = df
    if lookback_days and spec.segment_seconds != 86_400:
        # a calendar frame includes every row of the current day (its peers), also later
        # ones: segments must then end on day boundaries
        spec = spec.with_(segment_seconds=86_400)
    hot = hot_entities(df, spec)
    spike_qs = {g.spike_q for g in groups if g.spike_q is not None}
    if spike_qs:
        (q,) = spike_qs
        if thresholds is not None:
            base = join_nullsafe(base, thresholds, [spec.entity], "left")
        elif hot is None:
            # no hot entity: thresholds as whole-entity window aggregates, in the same
            # exchange and sort as the features (no second pass over the panel, no join);
            # each buffer holds one entity, at most hot_rows rows
            # (same order as the feature windows, so that one sort serves both)
            whole = Window.partitionBy(spec.entity).orderBy(*spec.order).rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)
            base = base.select("*", *[F.percentile(F.col(m).cast("double"), q).over(whole).alias(THR + m)
                                      for m in measures])
        else:
            base = join_nullsafe(base, entity_thresholds(df, spec, measures, q, hot), [spec.entity], "left")
    lay = layout(base, spec, lookback, lookback_days, hot=hot)
    framed = lay.df
    w = lay.window()
    if any(g.needs_rn for g in groups):
        framed = framed.withColumn(RN, F.row_number().over(w))
    if lookback_days:
        framed = framed.withColumn(DAYCOL, day_number(spec.time))
    cols, names = [], []
    for m in measures:
        x = F.col(m).cast("double")
        for g in groups:
            for c in g.build(m, x, lay, w):
                cols.append(c)
    out = framed.select("*", *cols)
    names = [c for c in out.columns if c not in framed.columns]
    keep = [c for c in df.columns] + names
    return lay.finish(out, names).select(*keep)
