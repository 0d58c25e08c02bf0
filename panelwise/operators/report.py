"""Reports and exports (WIN13, EXP1-4, AGG5-7, AGG12-14, SRT4-5, PRJ12-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mask
from ..spec import PanelSpec


def latest(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """WIN13: the latest row per entity (ties broken by ``spec.tiebreak``).

    ``max_by`` over a struct is a partial aggregation: each map task keeps one row per
    entity before the shuffle, so a hot entity costs no more than any other.
    """
    others = [c for c in df.columns if c != spec.entity]
    order = F.struct(*[F.col(c) for c in spec.order])
    row = F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_r")
    return df.groupBy(spec.entity).agg(row).select(spec.entity, *[F.col(f"_r.{c}").alias(c) for c in others])


def label_counts(df: DataFrame, label: str = "failure") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "failure") -> DataFrame:
    """AGG6: ``N / (K * n_k)`` per class; K rows."""
    c = label_counts(df, label)
    tot = c.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"))
    s = tot.select(F.struct("N", "K")).scalar()
    return c.select(label, "n", (s["N"] / (s["K"] * F.col("n"))).alias("class_weight"))


def failure_rate(df: DataFrame, label: str = "failure") -> DataFrame:
    return df.agg((F.avg(F.col(label).cast("double")) * 100).alias("failure_rate"))


def fleet_summary(latest_scored: DataFrame, spec: PanelSpec, level: str = "risk_level") -> DataFrame:
    """AGG12 / S20: counts disks (one latest row each), not rows."""
    lv = F.col(level)
    return latest_scored.agg(F.count_distinct(spec.entity).alias("total_disks"),
                             F.count_if(lv == "low").alias("healthy"),
                             F.count_if(lv == "medium").alias("warning"),
                             F.count_if(lv == "high").alias("critical"),
                             (F.avg(F.col(spec.label).cast("double")) * 100).alias("failure_rate"))


def risk_by_date(scored: DataFrame, spec: PanelSpec, level: str = "risk_level") -> DataFrame:
    """AGG13: per date, rows, failures and warnings (medium or high)."""
    return (scored.groupBy(F.to_date(spec.time).alias("date"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col(spec.label) == 1).alias("failures"),
                 F.count_if(F.col(level).isin("medium", "high")).alias("warnings")))


def risk_distribution(scored: DataFrame, level: str = "risk_level") -> DataFrame:
    """AGG14."""
    return scored.groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, by: str, n: int, tiebreak: list[str]) -> DataFrame:
    """SRT4/SRT5: the n largest by ``by`` (tie order by ``tiebreak``): TakeOrderedAndProject,
    a per-partition top-n then a merge of n rows per partition."""
    return df.orderBy(F.col(by).desc(), *[F.col(c) for c in tiebreak]).limit(n)


def entity_series(df: DataFrame, spec: PanelSpec, entity_value: Column, cols: list[str] | None = None) -> DataFrame:
    """EXP3/EXP4: one entity's rows in time order (the filter reaches the scan)."""
    out = df.filter(F.col(spec.entity) == entity_value)
    if cols is not None:
        out = out.select(spec.entity, spec.time, *cols)
    return out.orderBy(*spec.order)


def masked(df: DataFrame, spec: PanelSpec, salt: str) -> DataFrame:
    """PRJ12: replace the entity id by ``sha256(salt || id)``."""
    return df.withColumn(spec.entity, mask(spec.entity, salt))


def with_partitions(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """PRJ4: derive the ``year``, ``month`` partition columns."""
    return df.withColumn("year", F.year(spec.time)).withColumn("month", F.month(spec.time))


def expirable_partitions(df: DataFrame, spec: PanelSpec, as_of: Column, keep_months: int = 6) -> DataFrame:
    """PRJ13: (year, month) partitions entirely older than ``as_of - keep_months``; a report,
    nothing is deleted."""
    limit = F.add_months(F.to_date(as_of), -keep_months)
    parts = with_partitions(df, spec).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"),
                                                                  F.max(F.to_date(spec.time)).alias("last_day"))
    return parts.withColumn("expirable", F.col("last_day") < limit)


def monitoring(scored: DataFrame, spec: PanelSpec, prob: str = "failure_probability",
               prediction: str = "prediction") -> DataFrame:
    """ML24: per day, scored rows, labelled rows, accuracy on labelled rows, actual and
    predicted positives, mean probability (a batch job; no metrics server)."""
    y, p = F.col(spec.label), F.col(prediction)
    return (scored.groupBy(F.to_date(spec.time).alias("date"))
            .agg(F.count(F.lit(1)).alias("scored"), F.count(y).alias("labelled"),
                 F.avg(F.when(y.isNotNull(), (y == p).cast("double"))).alias("accuracy"),
                 F.count_if(y == 1).alias("actual_positive"), F.count_if(p == 1).alias("predicted_positive"),
                 F.avg(prob).alias("mean_probability")))


def refresh_latest(latest_table: DataFrame, new_rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """EXP5: the latest-row table after new rows arrive (old latest rows + new rows -> latest)."""
    return latest(latest_table.unionByName(new_rows, allowMissingColumns=True), spec)
