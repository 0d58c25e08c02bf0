"""Writers (SNK1-10, SCA12).  Executors write; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.report import with_partitions
from ..spec import PanelSpec


def write_partitioned(df: DataFrame, path: str, spec: PanelSpec, mode: str = "overwrite",
                      dynamic: bool = True) -> None:
    """SNK1: add ``year``/``month`` and write Parquet (snappy) partitioned by them.

    Rows are range-partitioned on (year, month, entity, time) first: each task writes a
    contiguous slice, so a month, and one entity in it, is split over many tasks (no one-task-per-month
    skew) and each task opens few files.  ``dynamic`` overwrites only the partitions
    present in ``df`` (incremental loads)."""
    out = with_partitions(df, spec)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(n, "year", "month", spec.entity, *spec.order)
    w = out.write.mode(mode).partitionBy("year", "month").option("compression", "snappy")
    if dynamic and mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def append_readings(df: DataFrame, path: str, spec: PanelSpec) -> None:
    """SNK3: append new readings to the partitioned store."""
    write_partitioned(df, path, spec, mode="append", dynamic=False)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: CSV with a header, written by the executors (one file per task)."""
    df.write.mode(mode).option("header", True).csv(path)


def export_per_entity(df: DataFrame, path: str, spec: PanelSpec, mode: str = "overwrite") -> None:
    """SCA12/EXP3: one CSV directory per entity (``{entity}=<id>/``).

    Range partitioning on (entity, time) keeps each entity in few tasks while a hot
    entity is still spread over several writers (several files in its directory)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, spec.entity, *spec.order).write.mode(mode).option("header", True)
     .partitionBy(spec.entity).csv(path))


def write_stats(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK6/SNK7/SNK9: statistics, metrics or importances (small frames) as Parquet or JSON."""
    df.repartition(1).write.mode(mode).format(fmt).save(path)  # only the small result meets in one task


def write_feature_list(spark, features: list[str], path: str) -> None:
    """SNK8: ``(ordinal, feature)`` of the true feature columns only (S22)."""
    schema = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("feature", T.StringType())])
    spark.createDataFrame(list(enumerate(features, 1)), schema).coalesce(1).write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK10: scored rows as JSON records."""
    df.write.mode(mode).json(path)


def save_model(model, path: str) -> None:
    """SNK4: the whole fitted pipeline (preprocessing included)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """SNK5."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def latest_export(latest: DataFrame) -> DataFrame:
    """EXP1: latest rows without the partition columns."""
    return latest.drop(*[c for c in ("year", "month") if c in latest.columns])
