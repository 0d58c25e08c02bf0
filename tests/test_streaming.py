"""STR1/STR2: incremental features over micro-batches equal the full computation."""

import pytest
from pyspark.sql import functions as F

from panelwise.operators import features as fe
from panelwise.sources.tables import SHIP_SPEC, ship_panel
from panelwise.streaming.incremental import fresh_dir, incremental_features, score_stream

from .conftest import SF_SMALL

GROUPS = [fe.rolling(("mean", "std"), (7, 30)), fe.deltas((30,)), fe.lags((1,)), fe.slope(7, 3)]


def _cmp(a, b):
    ka = {(r.serial_number, r.timestamp): r for r in a.collect()}
    kb = {(r.serial_number, r.timestamp): r for r in b.collect()}
    assert ka.keys() == kb.keys()
    for k in ka:
        for c in ("m_qty_mean_30d", "m_qty_std_7d", "m_qty_delta_30d", "m_qty_slope_7d"):
            assert ka[k][c] == pytest.approx(kb[k][c], rel=1e-9, abs=1e-9)


def test_incremental_equals_full(spark):
    p = ship_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_qty")
    cut = p.select(F.max("timestamp") - F.expr("INTERVAL 60 DAYS")).scalar()
    full = fe.add_features(p, SHIP_SPEC, GROUPS, ["m_qty"]).filter(F.col("timestamp") >= cut)
    inc = incremental_features(p.filter(F.col("timestamp") < cut), p.filter(F.col("timestamp") >= cut),
                               SHIP_SPEC, GROUPS, ["m_qty"])
    _cmp(full, inc)


def test_stream_batches_equal_full(spark):
    p = ship_panel(spark, SF_SMALL).select("serial_number", "timestamp", "m_qty").filter(
        F.col("timestamp") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    base = fresh_dir(spark, "test-stream")
    years = [r[0] for r in p.select(F.year("timestamp")).distinct().orderBy(1).collect()]
    for y in years:  # one input file per year, written in time order: one micro-batch each
        p.filter(F.year("timestamp") == y).coalesce(1).write.parquet(f"{base}/input/y={y}")
    schema = spark.read.parquet(f"{base}/input").schema
    score_stream(spark, f"{base}/input", schema, SHIP_SPEC, GROUPS, lambda f: f, f"{base}/out",
                 f"{base}/context", f"{base}/ck", max_files=1)
    got = spark.read.parquet(f"{base}/out").drop("y", "batch")
    assert got.count() == p.count()
    full = fe.add_features(p, SHIP_SPEC, GROUPS, ["m_qty"])
    _cmp(full, got)
