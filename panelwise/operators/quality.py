"""Data-quality checks (AGG1-4, AGG15-19): one aggregation pass for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import day_number, is_missing
from ..spec import PanelSpec

# Quality contract thresholds.
MISSING_WARN = 0.05      # missing rate per column
KEY_MISSING_WARN = 0.01  # missing rate for key attributes
OUTLIER_WARN = 0.01      # share of rows outside mean +- 3 std
SIGMA = 3.0


def _long(df: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row wide aggregate ``{field}__{col}`` into one row per column."""
    rows = [F.struct(F.lit(c).alias("column"),
                     *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in cols]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_rate(df: DataFrame, cols: list[str], threshold: float = MISSING_WARN,
                 key_cols: tuple[str, ...] = (), key_threshold: float = KEY_MISSING_WARN) -> DataFrame:
    """Per column: rows, missing (NULL or NaN), rate (0 for an empty frame) and breach flag."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(F.count_if(is_missing(F.col(c))).alias(f"missing__{c}"))
    wide = df.agg(*aggs)
    for c in cols:
        wide = wide.withColumn(f"rows__{c}", F.col("_n"))
    out = _long(wide, cols, {"rows": "", "missing": ""})
    rate = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(F.lit(0.0))
    limit = F.lit(threshold)
    for k in key_cols:
        limit = F.when(F.col("column") == k, F.lit(key_threshold)).otherwise(limit)
    return out.select("column", "rows", "missing", rate.alias("missing_rate"),
                      (rate > limit).alias("breach"))


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and sample std of each column (NULL mean -> 0, NULL std -> 0)."""
    aggs = []
    for c in cols:
        aggs += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean__{c}"),
                 F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std__{c}")]
    return df.agg(*aggs)


def outlier_bounds(df: DataFrame, cols: list[str], k: float = SIGMA) -> DataFrame:
    """Per column: mean, std and the ``[mean - k std, mean + k std]`` bounds."""
    out = _long(moments(df, cols), cols, {"mean": "", "std": ""})
    return out.select("column", "mean", "std",
                      (F.col("mean") - k * F.col("std")).alias("lower"),
                      (F.col("mean") + k * F.col("std")).alias("upper"))


def bounds_struct(df: DataFrame, cols: list[str], k: float = SIGMA) -> dict[str, Column]:
    """Every column's bounds from one aggregation pass; the single result row is read
    once and used as literals (``lo__c``, ``hi__c``)."""
    m = moments(df, cols)
    fields = []
    for c in cols:
        fields += [(F.col(f"mean__{c}") - k * F.col(f"std__{c}")).alias(f"lo__{c}"),
                   (F.col(f"mean__{c}") + k * F.col(f"std__{c}")).alias(f"hi__{c}")]
    row = m.select(*fields).first().asDict()  # exactly one row
    return {name: F.lit(v).cast("double") for name, v in row.items()}


def outlier_rate(df: DataFrame, cols: list[str], k: float = SIGMA,
                 threshold: float = OUTLIER_WARN) -> DataFrame:
    """Per column: count and share of rows outside the bounds (second pass)."""
    b = bounds_struct(df, cols, k)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        x = F.col(c)
        aggs.append(F.count_if((x < b[f"lo__{c}"]) | (x > b[f"hi__{c}"])).alias(f"outliers__{c}"))
    wide = df.agg(*aggs)
    for c in cols:
        wide = wide.withColumn(f"rows__{c}", F.col("_n"))
    out = _long(wide, cols, {"rows": "", "outliers": ""})
    rate = F.when(F.col("rows") > 0, F.col("outliers") / F.col("rows")).otherwise(F.lit(0.0))
    return out.select("column", "rows", "outliers", rate.alias("outlier_rate"),
                      (rate > threshold).alias("breach"))


def continuity(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per entity: first/last day, days present, days expected and days missing (AGG16)."""
    d = day_number(spec.time)
    out = df.groupBy(spec.entity).agg(F.min(F.to_date(spec.time)).alias("first_day"),
                                      F.max(F.to_date(spec.time)).alias("last_day"),
                                      F.count_distinct(d).alias("days_present"),
                                      (F.max(d) - F.min(d) + 1).cast("long").alias("days_expected"))
    return out.withColumn("days_missing", F.col("days_expected") - F.col("days_present"))


def gaps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every break in daily continuity: (entity, gap_start, gap_days)."""
    days = df.select(spec.entity, day_number(spec.time).alias("_d")).distinct()
    from ..plans.segments import layout
    lay = layout(days.withColumn(spec.time, F.date_from_unix_date("_d")), spec, 1)
    w = lay.window()
    nxt = lay.df.withColumn("_prev", F.lag("_d").over(w))
    nxt = lay.finish(nxt, ["_prev"])
    return (nxt.filter(F.col("_d") - F.col("_prev") > 1)
            .select(spec.entity, F.date_from_unix_date(F.col("_prev") + 1).alias("gap_start"),
                    (F.col("_d") - F.col("_prev") - 1).cast("long").alias("gap_days")))


def freshness(df: DataFrame, spec: PanelSpec, as_of: Column, max_delay_days: int = 1) -> DataFrame:
    """Per entity: last reading, days since it at ``as_of`` and a stale flag (T+1 rule)."""
    out = df.groupBy(spec.entity).agg(F.max(spec.time).alias("last_ts"))
    lag = F.datediff(F.to_date(as_of), F.to_date("last_ts"))
    return out.select(spec.entity, "last_ts", lag.alias("days_since"),
                      (lag > max_delay_days).alias("stale"))


def value_range(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Per column: rows outside a configured [min, max] (AGG18)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c, (lo, hi) in ranges.items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        aggs.append(F.count_if(bad).alias(f"out_of_range__{c}"))
    wide = df.agg(*aggs)
    cols = list(ranges)
    for c in cols:
        wide = wide.withColumn(f"rows__{c}", F.col("_n"))
    return _long(wide, cols, {"rows": "", "out_of_range": ""})


def label_accuracy(df: DataFrame, audit: DataFrame, keys: list[str], label: str,
                   audited: str) -> DataFrame:
    """Agreement of labels with an audited table joined on ``keys`` (AGG19)."""
    j = df.select(*keys, label).join(audit.select(*keys, audited), keys)
    return j.agg(F.count(F.lit(1)).alias("audited_rows"),
                 F.avg((F.col(label) == F.col(audited)).cast("double")).alias("label_accuracy"))
