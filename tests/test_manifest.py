"""Append with rollback: failed, repeated and racing appends leave exactly one copy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwise.plans.materialize import fresh_dir
from panelwise.sinks import manifest
from panelwise.spec import PanelSpec

SPEC = PanelSpec(measures=("x",))


def part(spark, lo, hi, extra=False):
    rows = [(f"e{i % 3}", dt.datetime(2026, 1 + i % 4, 1 + i % 28), float(i)) for i in range(lo, hi)]
    df = spark.createDataFrame(rows, "serial_number string, timestamp timestamp_ntz, x double")
    return df.withColumn("y", F.lit("new")) if extra else df


def xs(df):
    return sorted(r.x for r in df.select("x").collect())


def test_repeated_and_failed_appends(spark):
    root = fresh_dir(spark, "store")
    assert manifest.read(spark, root, part(spark, 0, 1).schema).count() == 0
    assert manifest.append(part(spark, 0, 10), root, SPEC, "b1") == 1
    assert manifest.append(part(spark, 0, 10), root, SPEC, "b1") == 1  # repeated: nothing
    bad = part(spark, 10, 20).withColumn("x", F.when(F.col("x") == 15, F.raise_error("broken row").cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception):
        manifest.append(bad, root, SPEC, "b2")
    assert xs(manifest.read(spark, root)) == list(range(10))
    assert manifest.append(part(spark, 10, 20), root, SPEC, "b2") == 2  # the retry
    assert xs(manifest.read(spark, root)) == list(range(20))
    assert len(manifest.staged_only(spark, root)) <= 1
    pruned = manifest.read(spark, root).filter("year = 2026 and month = 2")
    assert xs(pruned) == [float(i) for i in range(20) if i % 4 == 1]


def test_rollback_and_other_columns(spark):
    root = fresh_dir(spark, "store")
    for i in range(3):
        manifest.append(part(spark, 10 * i, 10 * i + 10, extra=i == 2), root, SPEC, f"b{i}")
    assert manifest.read(spark, root).filter("y = 'new'").count() == 10 and manifest.read(spark, root).count() == 30
    assert manifest.rollback(spark, root, 1) == 4
    assert xs(manifest.read(spark, root)) == list(range(10)) and xs(manifest.read(spark, root, version=3)) == list(range(30))
    manifest.append(part(spark, 10, 20), root, SPEC, "b1")  # its name counts no more: appended anew
    assert xs(manifest.read(spark, root)) == list(range(20))
    assert manifest.rollback(spark, root, 0) == 6 and manifest.batches(spark, root) == []
    with pytest.raises(ValueError):
        manifest.rollback(spark, root, 99)


def test_racing_writers(spark):
    root = fresh_dir(spark, "store")
    manifest.append(part(spark, 0, 10), root, SPEC, "b0")
    late = {"batch": "slow", **manifest.stage(part(spark, 10, 20), root, SPEC)}
    manifest.append(part(spark, 20, 30), root, SPEC, "fast")  # takes version 2
    with pytest.raises(manifest.Conflict):
        manifest._commit(spark, root, 2, [*manifest.batches(spark, root, 1), late])
    assert manifest._change(spark, root, lambda rows: [*rows, late]) == 3
    assert xs(manifest.read(spark, root)) == list(range(30))


def test_compact(spark):
    root = fresh_dir(spark, "store")
    for i in range(3):
        manifest.append(part(spark, 10 * i, 10 * i + 10), root, SPEC, f"b{i}")
    manifest.compact(spark, root, SPEC)
    assert len({b["folder"] for b in manifest.batches(spark, root)}) == 1 and xs(manifest.read(spark, root)) == list(range(30))
    manifest.append(part(spark, 0, 10), root, SPEC, "b0")  # still counts
    assert manifest.read(spark, root).count() == 30
