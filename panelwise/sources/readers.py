"""Readers for raw readings and feature tables (SRC1-4, SRC7, PRJ11).

Paths are any Hadoop file-system URI (``s3a://``, ``abfss://``, ``hdfs://``, local);
credentials stay in the cluster configuration.  Raw readers take the schema explicitly, so no
inference pass runs over the data (feature tables carry theirs in Parquet), and time-range readers filter on the ``year``/
``month`` partition columns so Spark prunes partitions before reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import nan_to_null
from ..spec import PanelSpec


def raw_schema(spec: PanelSpec, entity_type=T.StringType(), time_type=T.TimestampNTZType()) -> T.StructType:
    """Schema of raw readings: entity, time, label, one double per measure."""
    fields = [T.StructField(spec.entity, entity_type, False), T.StructField(spec.time, time_type, False)]
    if spec.label:
        fields.append(T.StructField(spec.label, T.IntegerType()))
    fields += [T.StructField(m, T.DoubleType()) for m in spec.measures]
    return T.StructType(fields)


def _clean(df: DataFrame, spec: PanelSpec) -> DataFrame:
    ms = set(spec.present(df))
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in ms else F.col(c) for c in df.columns])


def read_raw(spark: SparkSession, path: str, spec: PanelSpec, schema: T.StructType | None = None,
             fmt: str = "parquet") -> DataFrame:
    """SRC1: raw readings (Parquet by default); NaN becomes NULL (S3); no count on load."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return _clean(reader.load(path), spec)


def read_csv(spark: SparkSession, path: str, spec: PanelSpec, schema: T.StructType | None = None,
             timestamp_format: str | None = None) -> DataFrame:
    """SRC3 + PRJ11: CSV with a header; time text parsed to ``timestamp_ntz``."""
    schema = schema or raw_schema(spec, time_type=T.StringType())
    df = spark.read.option("header", True).schema(schema).csv(path)
    if isinstance(df.schema[spec.time].dataType, T.StringType):
        ts = (F.to_timestamp_ntz(F.col(spec.time), F.lit(timestamp_format)) if timestamp_format
              else F.to_timestamp_ntz(F.col(spec.time)))
        df = df.withColumn(spec.time, ts)
    return _clean(df, spec)


def read_features(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None,
                  spec: PanelSpec | None = None) -> DataFrame:
    """SRC2: feature table partitioned by ``year``/``month``.  With ``start``/``end`` the
    reader keeps ``start <= time < end`` and the matching partitions only."""
    df = spark.read.option("basePath", path).parquet(path)
    if start is None and end is None:
        return df
    spec = spec or PanelSpec()
    ym = F.col("year") * 100 + F.col("month")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ym >= F.year(start) * 100 + F.month(start)) & (F.col(spec.time) >= start)
    if end is not None:
        cond = cond & (ym <= F.year(end) * 100 + F.month(end)) & (F.col(spec.time) < end)
    return df.filter(cond)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """SRC4: a catalog table."""
    return spark.table(name)
