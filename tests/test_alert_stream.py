"""Cooldown alerts over late rows: equal to the batch fold, with tiebreak, NULL entity and ending state."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelwise.plans.materialize import fresh_dir
from panelwise.spec import PanelSpec
from panelwise.streaming.alert_stream import replay
from panelwise.streaming.alerts import cooldown_alerts

SPEC = PanelSpec(measures=(), label=None, hot_rows=None, tiebreak=("seq",))
BASE = dt.datetime(2026, 1, 1)
SCHEMA = "serial_number string, timestamp timestamp_ntz, seq int, note string"


def run(spark, batches, cooldown, delay, end=True):
    base = fresh_dir(spark, "alert-stream")
    last = max(t for b in batches for _, t, _, _ in b)
    if end:  # a far row of another entity moves the watermark past all others
        batches = [*batches, [("end", last + dt.timedelta(days=400), 0, "")], [("end", last + dt.timedelta(days=800), 0, "")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/b{i:02d}")
    replay(spark, f"{base}/in", spark.read.schema(SCHEMA).parquet(f"{base}/in/b00").schema, SPEC, cooldown, f"{base}/out", f"{base}/ck", delay, 1)
    out = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/out").filter("serial_number is null or serial_number <> 'end'")
    return sorted([tuple(r) for r in out.collect()], key=repr), base


def test_late_rows_tiebreak_and_null_entity(spark):
    r = random.Random(4)
    rows = []
    for ent in ("a", "b", None):
        for i in range(60):
            rows.append((ent, BASE + dt.timedelta(minutes=r.randrange(0, 2000), microseconds=r.choice([0, 7])), i, f"n{i} \"q\"|x"))
        rows.append((ent, rows[-1][1], 99, None))  # equal times: the smaller tiebreak is sent
    rows.sort(key=lambda x: x[1] + dt.timedelta(minutes=r.randrange(0, 100)))  # up to 100 minutes late
    batches = [rows[i:i + 40] for i in range(0, len(rows), 40)]
    got, _ = run(spark, batches, 45, "2 hours")
    want = cooldown_alerts(spark.createDataFrame(rows, SCHEMA), SPEC, 45)
    assert got == sorted([tuple(x) for x in want.collect()], key=repr)
    assert {g[0] for g in got} == {"a", "b", None}


def test_rows_behind_the_watermark_are_dropped_and_waiting_ones_stay(spark):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    batches = [[("a", at(0), 0, "x"), ("a", at(500), 1, "x")], [("a", at(501), 2, "x")], [("a", at(100), 3, "late"), ("a", at(900), 4, "x")]]
    got, _ = run(spark, batches, 60, "60 minutes", end=False)
    assert sorted(g[1] for g in got) == [at(0), at(500)]  # minute 100 came behind 441, minute 900 waits
    got, _ = run(spark, batches, 60, "60 minutes")
    assert sorted(g[1] for g in got) == [at(0), at(500), at(900)]


def test_state_of_silent_entities_ends(spark):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    batches = [[(f"d{i}", at(i), 0, "x") for i in range(20)], [("z", at(5000), 0, "x")], [("z", at(6000), 1, "x")], [("z", at(7000), 1, "x")]]
    got, base = run(spark, batches, 60, "10 minutes", end=False)
    assert {g[0] for g in got} >= {f"d{i}" for i in range(20)}
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{base}/ck")
    assert state.filter(F.col("key.serial_number").startswith("d")).count() == 0
    assert state.count() <= 1


def test_an_entity_takes_few_state_messages():
    from types import SimpleNamespace

    from panelwise.streaming.alert_stream import Cooldown

    calls, state, timers = [], {}, set()
    value = SimpleNamespace(get=lambda: calls.append("get") or state.get(0), update=lambda v: calls.append("update") or state.update({0: v}),
                            clear=lambda: calls.append("clear") or state.clear())
    handle = SimpleNamespace(getValueState=lambda *_: value, registerTimer=lambda t: calls.append("register") or timers.add(t),
                             deleteTimer=lambda t: calls.append("delete") or timers.discard(t))
    c = Cooldown("serial_number", 60_000_000, [])
    c.init(handle)
    at = lambda watermark_ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms)
    row = lambda us: {"us_": us, "row_": f"{us}|{{}}"}
    assert list(c.handleInputRows(("a",), [row(90_000_000), row(10_000_000)], at(0))) == [] and timers == {10_000}
    sent = list(c.handleInputRows(("a",), [row(20_000_000)], at(30_000)))
    assert [r.row_ for r in sent] == ["10000000|{}"] and timers == {90_000}
    sent = list(c.handleExpiredTimer(("a",), at(100_000), SimpleNamespace(getExpiryTimeInMs=lambda: 90_000)))
    assert [r.row_ for r in sent] == ["90000000|{}"] and timers == {90_000, 150_000}  # Spark ends the fired one
    assert list(c.handleExpiredTimer(("a",), at(200_000), SimpleNamespace(getExpiryTimeInMs=lambda: 150_000))) == [] and not state
    assert len(calls) <= 4 * 4 and calls.count("get") == 4


def test_state_store_settings_return(spark):
    from panelwise.streaming.alert_stream import with_state_store

    key = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    before = spark.conf.get(key, None)
    with with_state_store(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
