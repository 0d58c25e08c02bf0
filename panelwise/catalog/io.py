"""Source/sink round trips (SNK1-3, SRC1-3): written to the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sinks
from ..sources.readers import raw_schema, read_csv, read_features, read_raw, read_table
from ..sources.reports import parse_reports, to_reports
from ..sources.tables import EVENT_SPEC, SHIP_SPEC, event_panel, ship_panel
from ..plans.materialize import fresh_dir, written
from ..sinks import manifest
from . import ORACLE, register
from . import scaling  # noqa: F401  its SQL is used below
from ..operators import features as fe
from ..operators import scale
from .common import E, P1, P2, TS, rounded, sql_frame, sql_r6


@register("partitioned_roundtrip", f"{P2} SELECT {E}, {TS}, {sql_r6('m_qty')} AS m_qty, failure, "
          f"CAST(year({TS}) AS INTEGER) AS year, CAST(month({TS}) AS INTEGER) AS month FROM p "
          f"WHERE {TS} >= TIMESTAMP '1995-03-01' AND {TS} < TIMESTAMP '1996-07-01'")
def partitioned_roundtrip(spark, sf_dir):
    """P2 written partitioned by year/month, read back for a time range: only the
    partitions of the range are listed (partition pruning)."""
    path = fresh_dir(spark, "features")
    sinks.write_partitioned(ship_panel(spark, sf_dir).select(E, "timestamp", "m_qty", "failure"), path, SHIP_SPEC)
    start = F.lit("1995-03-01 00:00:00").cast("timestamp_ntz")
    end = F.lit("1996-07-01 00:00:00").cast("timestamp_ntz")
    df = read_features(spark, path, start, end, SHIP_SPEC)
    return rounded(df.select(E, "timestamp", "m_qty", "failure", "year", "month"))


@register("csv_roundtrip", f"{P1} SELECT {E}, {TS}, failure, m_value, m_purchase, m_error FROM p")
def csv_roundtrip(spark, sf_dir):
    """P1 written as CSV with a header and read back with an explicit schema (time text
    parsed to timestamp_ntz)."""
    path = fresh_dir(spark, "csv")
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure", "m_value", "m_purchase", "m_error")
    sinks.write_csv(p.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), path)
    return read_csv(spark, path, EVENT_SPEC, timestamp_format="yyyy-MM-dd HH:mm:ss")


@register("parquet_append", f"{P1} SELECT {E}, {TS}, failure, m_value, m_purchase, m_error FROM p")
def parquet_append(spark, sf_dir):
    """SNK3 + SRC1: readings appended day range by day range, then read raw with a schema."""
    path = fresh_dir(spark, "raw")
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure", "m_value", "m_purchase", "m_error")
    cut = p.select(F.max("timestamp") - F.expr("INTERVAL 10 DAYS")).scalar()
    sinks.append_readings(p.filter(F.col("timestamp") < cut), path, EVENT_SPEC)
    sinks.append_readings(p.filter(F.col("timestamp") >= cut), path, EVENT_SPEC)
    schema = raw_schema(EVENT_SPEC)
    return read_raw(spark, path, EVENT_SPEC, schema=schema).select(E, "timestamp", "failure", *EVENT_SPEC.measures)


@register("stats_roundtrip", ORACLE["zscore"])
def stats_roundtrip(spark, sf_dir):
    """SNK6/7: scaling statistics saved as JSON, read back and applied."""
    path = fresh_dir(spark, "stats")
    p = event_panel(spark, sf_dir).select(E, "timestamp", *EVENT_SPEC.measures)
    cols = list(EVENT_SPEC.measures)
    stats = scale.fit_zscore(p, cols)
    sinks.write_stats(stats, path, fmt="json")
    return rounded(scale.transform_zscore(p, spark.read.schema(stats.schema).json(path), cols))


@register("entity_export", f"{P1} SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value FROM p")
def entity_export(spark, sf_dir):
    """SCA12: one CSV folder per entity, read back with the entity from the folder name."""
    path = fresh_dir(spark, "entities")
    p = event_panel(spark, sf_dir).select(E, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "m_value")
    sinks.export_per_entity(p, path, EVENT_SPEC)
    back = spark.read.schema(f"timestamp string, m_value double, {E} string").option("header", True).csv(path)
    return rounded(back.select(E, F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"), "m_value"))


@register("records_roundtrip", f"{P1} SELECT {E}, failure, n_events, {sql_r6('m_value')} AS m_value FROM p")
def records_roundtrip(spark, sf_dir):
    """SNK10: rows written as JSON records and read back."""
    path = fresh_dir(spark, "records")
    p = event_panel(spark, sf_dir).select(E, "failure", "n_events", "m_value")
    sinks.write_records(p, path)
    return rounded(spark.read.schema(p.schema).json(path))


@register("append_once", f"{P1} SELECT {E}, {TS}, failure, m_value, m_purchase, m_error FROM p")
def append_once(spark, sf_dir):
    """SNK3 with rollback: three batches by day, one staged and never committed, one appended twice, one
    rolled back and appended again; every row is there once."""
    root = fresh_dir(spark, "store")
    p = written(event_panel(spark, sf_dir).select(E, "timestamp", "failure", "m_value", "m_purchase", "m_error"), "append-rows")
    last = p.select(F.max("timestamp")).scalar()
    days = F.datediff(F.to_date(last), F.to_date("timestamp"))
    parts = [p.filter(days >= 15), p.filter((days >= 5) & (days < 15)), p.filter(days < 5)]
    manifest.append(parts[0], root, EVENT_SPEC, "old")
    manifest.stage(parts[1], root, EVENT_SPEC)  # a writer that failed before its commit
    first = manifest.append(parts[1], root, EVENT_SPEC, "middle")
    manifest.append(parts[1], root, EVENT_SPEC, "middle")
    manifest.append(parts[0], root, EVENT_SPEC, "wrong")
    manifest.rollback(spark, root, first)
    manifest.append(parts[2], root, EVENT_SPEC, "new")
    return manifest.read(spark, root).select(*p.columns)


@register("table_roundtrip", f"{P1} SELECT {E}, {TS}, failure, m_value, m_purchase, m_error FROM p")
def table_roundtrip(spark, sf_dir):
    """SRC4: readings saved as a catalog table (its files in the shared folder) and read by name."""
    name = f"readings_{uuid.uuid4().hex}"
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure", "m_value", "m_purchase", "m_error")
    p.write.option("path", fresh_dir(spark, "table")).saveAsTable(name)
    return read_table(spark, name)


@register("rejected_reports", f"{P1}, w AS (SELECT CAST({TS} AS DATE) AS day, {E}, failure FROM p) "
          "SELECT day, count(*) FILTER (failure = 1) AS rejected, count(*) FILTER (failure = 0) AS readings FROM w GROUP BY day")
def rejected_reports(spark, sf_dir):
    """SRC6: the report lines of failing disks are cut short; they are kept apart with their text."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "failure", "n_events")
    whole = to_reports(p.filter("failure = 0"), {5: F.col("n_events")})
    broken = to_reports(p.filter("failure = 1"), {5: F.col("n_events")}).select(F.expr("substr(value, 1, length(value) - 3)").alias("value"))
    readings, rejected = parse_reports(whole.unionByName(broken))
    day = F.to_date(F.regexp_extract("line", r'"timestamp":"([^"T]+)', 1))
    both = rejected.select(day.alias("day"), F.lit(1).alias("r")).unionByName(
        readings.select(F.to_date("timestamp").alias("day"), F.lit(0).alias("r")))
    return both.groupBy("day").agg(F.count_if(F.col("r") == 1).alias("rejected"), F.count_if(F.col("r") == 0).alias("readings"))


_LISTED = ["m_value", "m_purchase", "m_error", "m_value_lag_1d", "m_purchase_lag_1d", "m_error_lag_1d"]


@register("feature_list", f"{P1} SELECT f.name AS feature, CAST(count(p.{E}) AS BIGINT) AS rows FROM p, (VALUES "
          + ", ".join(f"('{c}')" for c in _LISTED) + ") f(name) GROUP BY 1")
def feature_list(spark, sf_dir):
    """SNK8: the feature columns of a feature table (identity, label and time left out), written, read back and
    counted."""
    f = fe.add_features(event_panel(spark, sf_dir).select(E, "timestamp", "failure", *EVENT_SPEC.measures), EVENT_SPEC, [fe.lags((1,))])
    path = fresh_dir(spark, "features")
    sinks.write_feature_list(spark, EVENT_SPEC.feature_columns(f), path)
    names = spark.read.schema("ordinal int, feature string").parquet(path)
    n = f.agg(F.count(F.lit(1)).alias("rows"))
    return names.select("feature").join(F.broadcast(n))  # one row


@register("absent_measure", f"{P1} SELECT {E}, {TS}, {sql_r6('coalesce(avg(m_value) ' + sql_frame(7) + ', 0)')} AS m_value_mean_7d FROM p")
def absent_measure(spark, sf_dir):
    """PRJ1: a configured measure that the data lacks is skipped."""
    spec = EVENT_SPEC.with_(measures=("m_value", "m_temperature"))
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value")
    return rounded(fe.add_features(p, spec, [fe.rolling(("mean",), (7,))]).drop("m_value"))
