"""Cooldown alerts over a stream whose rows may come late (STR3).

Candidates are ordered before they are folded.  Per entity the state holds the candidates that
the watermark has not passed yet and the time of the last sent alert.  When the watermark passes a
candidate no earlier one can come any more: it is decided, in (time, tiebreak) order, by the same
fold as in batch.  A timer at the earliest waiting candidate wakes an entity that gets no new rows.

State ends by itself: the last sent time stops to matter one cooldown later, and a second timer
then clears it, so silent entities cost nothing.  Rows later than the admitted delay are dropped by
the watermark, as in any Spark stream.  Nothing is delivered; rows are returned as they came.
"""

from __future__ import annotations

import sys
from typing import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import epoch_seconds
from ..spec import PanelSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_US, _ROW, _EVENT = "us_", "row_", "event_"  # (names with a leading underscore reach the processor renamed)
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class Cooldown(StatefulProcessor):
    """Waiting candidates, the last sent time and the timer of one entity, as one value: each call to
    the state is a message to the JVM, so an entity takes one read, one write and at most two timer calls."""

    def __init__(self, entity: str, cooldown: int, types: list[str]):
        self.entity, self.cooldown, self.types = entity, cooldown, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = ", ".join([f"{_US}: bigint", f"{_ROW}: string", *[f"tie{i}_: {t}" for i, t in enumerate(self.types)]])
        self.last = handle.getValueState("last", f"us bigint, timer bigint, waiting array<struct<{row}>>")

    def _decide(self, key, new: list[tuple], watermark_ms: int, fired: int | None = None) -> Iterator[Row]:
        held = self.last.get()
        last, timer, waiting = held if held is not None else (None, None, [])
        rows = [tuple(r) for r in waiting] + new
        rows.sort(key=lambda r: (r[0], *[(v is not None, v) for v in r[2:]], r[1]))
        settled, sent = 0, []
        for r in rows:
            if r[0] > watermark_ms * 1000:
                break
            settled += 1
            if last is None or r[0] - last >= self.cooldown:
                last = r[0]
                sent.append(r[1])
        rest, wake = rows[settled:], None
        if rest:
            wake = max(-(-rest[0][0] // 1000), watermark_ms + 1)
        elif last is not None:
            over = -(-(last + self.cooldown) // 1000)  # from here on the last alert holds nothing back
            last, wake = (None, None) if over <= watermark_ms else (last, over)
        if timer != wake:
            if timer is not None and timer != fired:  # a fired one ends by itself
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if wake is None:
            if held is not None:
                self.last.clear()
        else:
            self.last.update((last, wake, rest))
        for r in sent:
            yield Row(**{self.entity: key[0], _ROW: r})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ties = [f"tie{i}_" for i in range(len(self.types))]
        new = [(r[_US], r[_ROW], *[None if r[t] != r[t] else r[t] for t in ties]) for r in rows]
        yield from self._decide(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._decide(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def ordered_alerts(stream: DataFrame, spec: PanelSpec, cooldown_minutes: float, late_delay: str = "1 day") -> DataFrame:
    """The candidates of a stream that are sent, all columns, once the watermark has passed them.
    Needs the RocksDB state store (``with_state_store``)."""
    cols = stream.columns
    us = F.round(epoch_seconds(spec.time) * F.lit(1_000_000.0)).cast("long")
    # the entity stays a column of its own (it may be null); the others travel as one JSON text
    body = F.to_json(F.struct(*[F.col(c) for c in cols if c not in (spec.entity, spec.time)]))
    ties = [F.col(c).alias(f"tie{i}_") for i, c in enumerate(spec.tiebreak)]
    rows = stream.select(F.col(spec.entity), us.alias(_US), F.concat(us.cast("string"), F.lit("|"), body).alias(_ROW), *ties)
    rows = rows.withColumn(_EVENT, F.timestamp_micros(_US)).withWatermark(_EVENT, late_delay)
    types = [stream.schema[c].dataType.simpleString() for c in spec.tiebreak]
    out_schema = T.StructType([stream.schema[spec.entity], T.StructField(_ROW, T.StringType())])
    sent = rows.groupBy(spec.entity).transformWithState(
        Cooldown(spec.entity, int(round(cooldown_minutes * 60 * 1_000_000)), types), out_schema, "append", "eventTime")
    inner = T.StructType([f for f in stream.schema.fields if f.name not in (spec.entity, spec.time)])
    at = F.substring_index(_ROW, "|", 1).cast("long")
    time = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (at.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    parsed = F.from_json(F.expr(f"substr({_ROW}, instr({_ROW}, '|') + 1)"), inner)
    got = sent.select(F.col(spec.entity), time.cast(stream.schema[spec.time].dataType).alias(spec.time), parsed.alias("_b"))
    return got.select(*[F.col(c) if c in (spec.entity, spec.time) else F.col("_b").getField(c).alias(c) for c in cols])


class with_state_store:
    """The RocksDB state store, its commits as changelogs (a batch writes what it changed, snapshots are
    made beside it), for the queries started inside; the session's own settings return after."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in _STORE}
        for k, v in _STORE.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def replay(spark: SparkSession, source_dir: str, schema, spec: PanelSpec, cooldown_minutes: float, out_dir: str,
           checkpoint_dir: str, late_delay: str = "1 day", max_files: int | None = None) -> None:
    """Run the files of a folder through ``ordered_alerts`` until all is read (``availableNow``), sent
    rows to ``out_dir``.  Each micro-batch overwrites its own folder, so a retried batch adds nothing."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    sent = ordered_alerts(reader.parquet(source_dir), spec, cooldown_minutes, late_delay)

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    with with_state_store(spark):
        q = sent.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
        q.awaitTermination()
