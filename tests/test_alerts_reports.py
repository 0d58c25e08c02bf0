import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelwise.sources.reports import parse_reports, to_reports
from panelwise.sources.tables import event_panel
from panelwise.spec import PanelSpec
from panelwise.streaming.alerts import cooldown_alerts, stream_alerts

from .conftest import SF_SMALL

SPEC = PanelSpec(measures=(), label=None, hot_rows=None)


def test_cooldown_hand_panel(spark):
    base = dt.datetime(2026, 1, 1)
    mins = [0, 30, 61, 100, 121]
    df = spark.createDataFrame([("d1", base + dt.timedelta(minutes=m)) for m in mins] +
                               [("d2", base + dt.timedelta(minutes=5))],
                               "serial_number string, timestamp timestamp_ntz")
    sent = cooldown_alerts(df, SPEC, 60)
    got = sorted((r.serial_number, int((r.timestamp - base).total_seconds() // 60)) for r in sent.collect())
    assert got == [("d1", 0), ("d1", 61), ("d1", 121), ("d2", 5)]


def _brute(times, cooldown):
    sent, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            sent.append(t)
            last = t
    return sent


def test_cooldown_segments_equal_sequential(spark):
    import random
    rng = random.Random(11)
    base = dt.datetime(2026, 1, 1)
    data = [(f"d{i % 3}", rng.randint(0, 5000)) for i in range(600)]
    df = spark.createDataFrame([(e, base + dt.timedelta(minutes=m)) for e, m in data],
                               "serial_number string, timestamp timestamp_ntz").dropDuplicates()
    for seg in (60, 97, 400):  # every entity segmented
        sent = cooldown_alerts(df, SPEC, 60, segment_minutes=seg, hot_rows=0)
        got = {}
        for r in sent.collect():
            got.setdefault(r.serial_number, []).append(int((r.timestamp - base).total_seconds() // 60))
        for ent in {e for e, _ in data}:
            assert sorted(got.get(ent, [])) == _brute({m for e, m in data if e == ent}, 60), (seg, ent)


def test_cooldown_mixed_hot_and_plain(spark):
    import random
    rng = random.Random(5)
    base = dt.datetime(2026, 1, 1)
    data = [("big", rng.randint(0, 20000)) for _ in range(500)] + \
           [(f"s{i}", rng.randint(0, 3000)) for i in range(12) for _ in range(15)]
    df = spark.createDataFrame([(e, base + dt.timedelta(minutes=m)) for e, m in data],
                               "serial_number string, timestamp timestamp_ntz").dropDuplicates()
    sent = cooldown_alerts(df, SPEC, 45, segment_minutes=120, hot_rows=100)   # only "big" is segmented
    got = {}
    for r in sent.collect():
        got.setdefault(r.serial_number, []).append(int((r.timestamp - base).total_seconds() // 60))
    for ent in {e for e, _ in data}:
        assert sorted(got.get(ent, [])) == _brute({m for e, m in data if e == ent}, 45), ent


def test_cooldown_segments_follow_row_counts(spark, monkeypatch):
    import random

    from panelwise.streaming import alerts
    rng = random.Random(7)
    base = dt.datetime(2026, 1, 1)
    data = [("big", rng.randint(0, 1400)) for _ in range(900)] + [("long", rng.randint(0, 90000)) for _ in range(900)]
    df = spark.createDataFrame([(e, base + dt.timedelta(minutes=m)) for e, m in data],
                               "serial_number string, timestamp timestamp_ntz").dropDuplicates()
    sizes, inner = [], alerts._segment_states

    def seen(*args):
        states, rows = inner(*args)
        sizes.extend(r["count"] for r in rows.groupBy("serial_number", alerts._SEG).count().collect())
        return states, rows

    monkeypatch.setattr(alerts, "_segment_states", seen)
    monkeypatch.setattr(alerts, "_FAN", 3)
    for cooldown in (45, 2880):  # all of "big" is one day, and within one long cooldown
        got = {}
        for r in cooldown_alerts(df, SPEC, cooldown, hot_rows=60).collect():
            got.setdefault(r.serial_number, []).append(int((r.timestamp - base).total_seconds() // 60))
        for ent in ("big", "long"):
            assert sorted(got[ent]) == _brute({m for e, m in data if e == ent}, cooldown), (cooldown, ent)
    assert len(sizes) > 40 and max(sizes) <= 180


def test_cooldown_transfer_is_a_few_runs():
    from panelwise.streaming.alerts import _transfer
    at, out = _transfer(np.arange(0, 100_000, 7), 50)
    assert len(at) == len(out) <= 9 and (out[1:] != out[:-1]).all()


def test_cooldown_stream_keeps_state(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    src = tmp_path / "alerts"
    schema = "serial_number string, timestamp timestamp_ntz"
    for i, mins in enumerate([[0, 30], [61, 100], [121]]):
        spark.createDataFrame([("d1", base + dt.timedelta(minutes=m)) for m in mins], schema) \
            .coalesce(1).write.parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(src))
    q = (stream_alerts(stream, SPEC, 60).writeStream.format("memory").queryName("alerts_out")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(int((r.timestamp - base).total_seconds() // 60) for r in spark.table("alerts_out").collect())
    assert got == [0, 61, 121]


def test_reports_roundtrip_and_rejects(spark):
    p = event_panel(spark, SF_SMALL)
    lines = to_reports(p, {5: F.col("n_events"), 187: F.round(F.col("m_purchase") * 100), 999: F.col("failure")})
    broken = spark.createDataFrame([("{not json",), ("[1, 2",)], "value string")
    readings, rejected = parse_reports(lines.unionByName(broken))
    assert rejected.count() == 2
    assert readings.count() == p.count()
    assert "smart_999_raw" not in readings.columns
    chk = readings.join(p, ["serial_number", "timestamp"]).filter(
        (F.col("smart_5_raw") != F.col("n_events").cast("double")) |
        (F.col("smart_187_raw").isNull() != F.col("m_purchase").isNull()))
    assert chk.count() == 0
    row = readings.first()
    assert row.model == "UNKNOWN" and row.capacity_bytes == 0


def test_report_defaults(spark):
    lines = spark.createDataFrame([('{"smart_table": [{"id": 5}, {"id": 5, "raw": {"value": 7}}, {"id": 1000}]}',)],
                                  "value string")
    readings, rejected = parse_reports(lines)
    r = readings.collect()[0]
    assert r.serial_number == "UNKNOWN" and r.smart_5_raw == 7.0 and r.smart_1_raw is None
    assert rejected.count() == 0
