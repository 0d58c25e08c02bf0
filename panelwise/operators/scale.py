"""Scaling as fit/transform pairs (SCL1-3, JOI1).

``fit_*`` returns a one-row statistics DataFrame (persist it with ``sinks.write_stats``);
``transform_*`` reads that single row once and applies it as literals, as Spark ML's
scalers do.  (A scalar subquery referenced by hundreds of scaled columns would copy the
whole upstream plan into every reference during optimization.)  Fit on the training
rows only (S9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import group_quantiles


def fit_zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """mean and sample std per column; NULL mean -> 0, NULL or 0 std -> 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_samp(c)
        aggs += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean__{c}"),
                 F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd).alias(f"std__{c}")]
    return df.agg(*aggs)


def fit_robust(df: DataFrame, cols: list[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """median and IQR per column; NULL median -> 0, IQR <= 0 or NULL -> 1 (S10).

    ``exact`` uses distributed exact quantiles (``plans.ranks``); otherwise
    ``percentile_approx`` (one mergeable sketch per column, a single pass).
    """
    if exact:
        # all columns stacked into (column, value) rows: one bucketed rank pass
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_s"))
        long = group_quantiles(stacked.select("_s._col", "_s._x"), ["_col"], "_x",
                               {"p25": 0.25, "median": 0.5, "p75": 0.75})
        wide = long.agg(*[F.max(F.when(F.col("_col") == c, F.col(n))).alias(f"{n}__{c}")
                          for c in cols for n in ("p25", "median", "p75")])
        out = wide
    else:
        aggs = []
        for c in cols:
            aggs.append(F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias(f"_q__{c}"))
        out = df.agg(*aggs).select(*[F.col(f"_q__{c}")[i].alias(f"{n}__{c}") for c in cols
                                     for i, n in enumerate(("p25", "median", "p75"))])
    sel = []
    for c in cols:
        iqr = F.col(f"p75__{c}") - F.col(f"p25__{c}")
        sel += [F.coalesce(F.col(f"median__{c}"), F.lit(0.0)).alias(f"median__{c}"),
                F.when(iqr.isNull() | (iqr <= 0), F.lit(1.0)).otherwise(iqr).alias(f"iqr__{c}")]
    return out.select(*sel)


def fit_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min__{c}"), F.max(c).alias(f"max__{c}")]
    return df.agg(*aggs)


def _apply(df: DataFrame, stats: DataFrame, cols: list[str], expr, keep_original: bool) -> DataFrame:
    row = stats.first().asDict()  # exactly one row
    s = {k: F.lit(v).cast("double") for k, v in row.items()}
    cs = set(cols)
    base = [F.col(c) for c in df.columns if keep_original or c not in cs]
    return df.select(*base, *[expr(F.col(c), s, c).alias(f"{c}_scaled") for c in cols])


def transform_zscore(df, stats, cols, keep_original=False):
    return _apply(df, stats, cols, lambda x, s, c: (x - s[f"mean__{c}"]) / s[f"std__{c}"], keep_original)


def transform_robust(df, stats, cols, keep_original=False):
    return _apply(df, stats, cols, lambda x, s, c: (x - s[f"median__{c}"]) / s[f"iqr__{c}"], keep_original)


def transform_minmax(df, stats, cols, keep_original=False):
    def f(x, s, c):
        rng = s[f"max__{c}"] - s[f"min__{c}"]
        return F.when(rng == 0, F.lit(0.0)).otherwise((x - s[f"min__{c}"]) / rng)
    return _apply(df, stats, cols, f, keep_original)


def standardize(df: DataFrame, cols: list[str], method: str = "zscore", fit_on: DataFrame | None = None,
                keep_original: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fit on ``fit_on`` (default ``df``) and transform ``df``; returns (scaled, stats)."""
    src = df if fit_on is None else fit_on
    fits = {"zscore": (fit_zscore, transform_zscore), "robust": (fit_robust, transform_robust),
            "minmax": (fit_minmax, transform_minmax)}
    if method not in fits:
        raise ValueError(f"unknown scaling method {method!r}; expected one of {sorted(fits)}")
    fit, tr = fits[method]
    stats = fit(src, cols)
    return tr(df, stats, cols, keep_original), stats
