"""Sinks, readers and the end-to-end feature job."""

import datetime as dt

from pyspark.sql import functions as F

from panelwise import sinks
from panelwise.plans.feature_job import build_features
from panelwise.sources.readers import read_csv, read_features, read_raw
from panelwise.sources.tables import EVENT_SPEC, SHIP_SPEC, event_panel, ship_panel
from panelwise.streaming.incremental import fresh_dir

from .conftest import SF_SMALL


def test_partitioned_write_dynamic_overwrite_and_pruned_read(spark):
    p = ship_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_qty")
    path = fresh_dir(spark, "t-part")
    sinks.write_partitioned(p, path, SHIP_SPEC)
    one_month = p.filter((F.year("timestamp") == 1995) & (F.month("timestamp") == 3))
    sinks.write_partitioned(one_month.withColumn("m_qty", F.lit(-1.0)), path, SHIP_SPEC)  # dynamic overwrite
    back = spark.read.parquet(path)
    assert back.count() == p.count()
    assert back.filter(F.col("m_qty") == -1.0).count() == one_month.count()
    rng = read_features(spark, path, F.lit("1995-03-01").cast("timestamp_ntz"),
                        F.lit("1995-04-01").cast("timestamp_ntz"), SHIP_SPEC)
    plan = rng._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert rng.count() == one_month.count()


def test_csv_and_raw_readers(spark):
    p = event_panel(spark, SF_SMALL).select("serial_number", "timestamp", "failure", "m_value", "m_purchase", "m_error")
    path = fresh_dir(spark, "t-csv")
    sinks.write_csv(p, path)
    back = read_csv(spark, path, EVENT_SPEC)
    assert back.schema["timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert back.exceptAll(p).count() == 0 and p.exceptAll(back).count() == 0
    nan = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 1, float("nan"), None, 1.0)], p.schema)
    raw_path = fresh_dir(spark, "t-raw")
    nan.write.parquet(raw_path)
    r = read_raw(spark, raw_path, EVENT_SPEC).collect()[0]
    assert r.m_value is None                       # NaN is missing (S3)


def test_export_per_entity_and_stats(spark):
    p = event_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_value")
    path = fresh_dir(spark, "t-exp")
    sinks.export_per_entity(p, path, EVENT_SPEC)
    back = spark.read.option("header", True).csv(path)
    assert back.select("serial_number").distinct().count() == p.select("serial_number").distinct().count()
    sinks.write_feature_list(spark, ["a", "b"], fresh_dir(spark, "t-fl"))


def test_feature_job_end_to_end(spark):
    p = event_panel(spark, SF_SMALL)
    train = p.filter(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz"))
    res = build_features(p, EVENT_SPEC, outliers="clip", scale_method="zscore", fit_on=None)
    f = res.features
    assert f.count() == p.count()
    assert res.missing.count() == 3 and res.outliers.count() == 3
    assert "m_value_mean_7d_scaled" in f.columns and "m_value_mean_7d" not in f.columns
    assert f.filter(F.col("m_purchase_scaled").isNull()).count() == 0      # imputed before scaling
    res2 = build_features(p, EVENT_SPEC, outliers=None, scale_method="robust", fit_on=None)
    assert res2.scale_stats.count() == 1
    assert train.count() < p.count()
