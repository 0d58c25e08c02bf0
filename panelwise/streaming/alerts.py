"""Alert rows with a per-entity cooldown (STR3).

"At most one alert per entity within ``cooldown`` of the last *sent* one" is a fold over
an entity's alert candidates in time order.  In batch it runs without holding an entity
in one task: the rows are range-partitioned into segments of about ``hot_rows`` rows, and

1. per (entity, segment), in parallel: the last sent alert after the segment is a step
   function of the one before it.  It is kept as runs of equal outcomes;
2. neighbouring segments are composed ``_FAN`` at a time in rounds, up to one function an
   entity, and on the way back each segment gets its true incoming state;
3. per (entity, segment) again, the fold is replayed from the true state and the sent
   rows are emitted.

Groups hold one segment of one entity, or ``_FAN`` functions (each has at most one run for
each candidate within ``cooldown`` of its start).  Entities below the hot threshold skip the segment
machinery: they are hash-partitioned, sorted and folded partition by partition
(``mapInPandas``, one Python call per Arrow batch).  In a stream, ``applyInPandasWithState`` keeps one
timestamp of state per entity.  Nothing is delivered; rows carry a JSON payload.
"""

from __future__ import annotations

import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import epoch_seconds
from ..plans.broadcast import bounded
from ..plans.joins import join_nullsafe
from ..plans.materialize import written
from ..spec import PanelSpec

# the pandas functions below run in Python workers that may not have this package on
# their path: ship this module's helpers by value (closures capture only plain values)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_US = "_t_us"
_SEG, _SPLIT, _NODE = "_aseg", "_asplit", "_anode"
#: Neighbouring segments composed at a time; incoming state before the first sent alert.
_FAN, _NONE = 16, -(2 ** 62)


def _fold(times: np.ndarray, cooldown: int, last) -> tuple[np.ndarray, object]:
    """Greedy cooldown over sorted integer times; returns (sent mask, last sent)."""
    sent = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        if last is not None:  # jump to the first time that may be sent: cost follows sent alerts
            i = i + int(np.searchsorted(times[i:], last + cooldown, side="left"))
            if i >= len(times):
                break
        sent[i] = True
        last = int(times[i])
        i += 1
    return sent, last


def _runs(at: np.ndarray, out: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function as runs of equal outcomes, for states up to ``start``."""
    n = int(np.searchsorted(at, start, side="left")) + 1
    at, out = at[:n], out[:n]
    keep = np.append(out[1:] != out[:-1], True)
    return at[keep], out[keep]


def _transfer(own: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """Last sent alert after sorted times as a step function of the one before: states up to
    ``at[k]`` (and above ``at[k - 1]``) give ``out[k]``, states above all stay as they are."""
    own = np.unique(own)
    nxt = np.maximum(np.searchsorted(own, own + cooldown, side="left"), np.arange(1, len(own) + 1)).tolist()
    out = own.tolist()
    for i in range(len(out) - 1, -1, -1):
        if nxt[i] < len(out):
            out[i] = out[nxt[i]]
    return _runs(own - cooldown, np.array(out, dtype="int64"), int(own[0]))


def _after(at: np.ndarray, out: np.ndarray, state: np.ndarray) -> np.ndarray:
    k = np.searchsorted(at, state, side="left")
    return np.where(k < len(at), out[np.minimum(k, len(at) - 1)], state)


def _composed(first, then, start: int) -> tuple[np.ndarray, np.ndarray]:
    late = then[0] > first[0][-1]
    return _runs(np.concatenate([first[0], then[0][late]]),
                 np.concatenate([_after(*then, first[1]), then[1][late]]), start)


def cooldown_alerts(candidates: DataFrame, spec: PanelSpec, cooldown_minutes: float,
                    segment_minutes: float | None = None, hot_rows: int | None = -1) -> DataFrame:
    """The candidates that are sent: the first of each entity, then every one at least
    ``cooldown_minutes`` after the previous sent one (ties on time: first by tiebreak).

    Only entities with more than ``hot_rows`` candidates (default ``spec.hot_rows``) are
    cut into segments of about as many rows, or of ``segment_minutes`` where given; the others
    are one group each.  ``hot_rows=0`` segments all.
    """
    e = spec.entity
    tiebreak = list(spec.tiebreak)
    cooldown = int(round(cooldown_minutes * 60 * 1_000_000))
    order = [spec.time, *spec.tiebreak]
    t_us = F.round(epoch_seconds(spec.time) * F.lit(1_000_000.0)).cast("long")
    keys = candidates.select(e, *order).withColumn(_US, t_us)
    limit = spec.hot_rows if hot_rows == -1 else hot_rows
    any_split = True
    if limit is None:
        keys = keys.withColumn(_SPLIT, F.lit(False))
        any_split = False
    elif limit == 0:
        keys = keys.withColumn(_SPLIT, F.lit(True))
    else:
        hot = candidates.groupBy(e).count().filter(F.col("count") > limit).select(e)
        hot_list = hot.limit(100_001).collect()  # at most rows / hot_rows entities
        if not hot_list:
            keys = keys.withColumn(_SPLIT, F.lit(False))
            any_split = False
        else:
            marks = (F.broadcast(candidates.sparkSession.createDataFrame(hot_list, hot.schema))
                     if len(hot_list) <= 100_000 else bounded(hot)[0]).withColumn(_SPLIT, F.lit(True))
            keys = join_nullsafe(keys, marks, [e], "left").withColumn(_SPLIT, F.coalesce(F.col(_SPLIT), F.lit(False)))
    if any_split:
        states, segments = _segment_states(keys.filter(_SPLIT).drop(_SPLIT), e, cooldown, segment_minutes, limit or spec.hot_rows or 100_000)

    out_schema = T.StructType([candidates.schema[c] for c in (e, *order)])

    def step3(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([_US, *tiebreak], kind="mergesort")
        st = int(pdf["_state"].iloc[0])
        sent, _ = _fold(pdf[_US].to_numpy(dtype="int64"), cooldown, None if st == _NONE else st)
        return pdf.loc[sent, [e, *order]]

    def fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows arrive sorted by (entity, time, tiebreak) within the partition, across
        # Arrow batches: one pass, state reset at each new entity
        cur, last = object(), None
        for pdf in batches:
            ents = pdf[e].to_numpy(dtype=object)
            ts = pdf[_US].to_numpy(dtype="int64")
            mask = np.zeros(len(pdf), dtype=bool)
            new = np.flatnonzero(np.concatenate([[True], ents[1:] != ents[:-1]])) if len(pdf) else []
            for a, b in zip(new, [*new[1:], len(pdf)]):
                if a or ents[0] != cur:
                    last = None
                mask[a:b], last = _fold(ts[a:b], cooldown, last)
                cur = ents[a]
            yield pdf.loc[mask, [e, *order]]

    # entities below the hot threshold: hash-partitioned by entity (each bounded by
    # hot_rows candidates), sorted, folded by partition with one Python call per batch
    plain = keys.filter(~F.col(_SPLIT)) if any_split else keys
    sent = (plain.select(e, *order, _US).repartition(e).sortWithinPartitions(e, _US, *tiebreak)
            .mapInPandas(fold_sorted, out_schema))
    if any_split:
        replay = join_nullsafe(segments, states, [e, _SEG], "left")
        sent = sent.unionByName(replay.groupBy(e, _SEG).applyInPandas(step3, out_schema))
    met = join_nullsafe(candidates, sent, [e, *order], "left_semi")
    # two candidates of one entity at one time without a tiebreak: one is sent
    pick = Window.partitionBy(e, *order).orderBy(F.xxhash64(*candidates.columns))
    return met.withColumn("_nth", F.row_number().over(pick)).filter(F.col("_nth") == 1).drop("_nth")


def _segment_states(rows: DataFrame, e: str, cooldown: int, segment_minutes: float | None,
                    segment_rows: int) -> tuple[DataFrame, DataFrame]:
    """(entity, segment, state before it) and the rows with their segment."""
    if segment_minutes is None:
        n = max(1, -(-rows.count() // segment_rows))
        rows = rows.repartitionByRange(n, e, _US).withColumn(_SEG, F.spark_partition_id().cast("long"))
    else:
        seg_len = max(int(round(segment_minutes * 60 * 1_000_000)), 1)
        first = rows.agg(F.min(_US)).first()[0] or 0  # segments are numbered from 0
        rows = rows.withColumn(_SEG, F.floor((F.col(_US) - F.lit(first)) / F.lit(seg_len)).cast("long"))
    rows = written(rows, "alert-segments")  # range bounds are sampled: the segments stay as they are
    ent = rows.schema[e]
    fn_schema = T.StructType([ent, T.StructField(_SEG, T.LongType()), T.StructField("_from", T.LongType()),
                              T.StructField("_at", T.ArrayType(T.LongType())), T.StructField("_out", T.ArrayType(T.LongType()))])
    st_schema = T.StructType([ent, T.StructField(_SEG, T.LongType()), T.StructField("_state", T.LongType())])

    def function_row(entity, seg, start, at, out) -> pd.DataFrame:
        return pd.DataFrame({e: [entity], _SEG: [int(seg)], "_from": [int(start)], "_at": [at.tolist()], "_out": [out.tolist()]})

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf[_US].to_numpy(dtype="int64"))
        return function_row(pdf[e].iloc[0], pdf[_SEG].iloc[0], own[0], *_transfer(own, cooldown))

    def functions(pdf: pd.DataFrame) -> list:
        return [(np.asarray(a, dtype="int64"), np.asarray(o, dtype="int64")) for a, o in zip(pdf["_at"], pdf["_out"])]

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_SEG)
        start, (fn, *others) = int(pdf["_from"].iloc[0]), functions(pdf)
        for f in others:
            fn = _composed(fn, f, start)
        return function_row(pdf[e].iloc[0], pdf[_NODE].iloc[0], start, *fn)

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_SEG)
        state, states = pdf["_state"].iloc[0], []
        for f in functions(pdf):
            states.append(int(state))
            state = _after(*f, np.int64(state))
        return pd.DataFrame({e: pdf[e], _SEG: pdf[_SEG], "_state": states})

    node = F.floor(F.col(_SEG) / F.lit(_FAN)).cast("long")
    levels = [written(rows.select(e, _SEG, _US).groupBy(e, _SEG).applyInPandas(leaf, fn_schema), "alert-functions")]
    while True:
        ends = levels[-1].agg(F.min(_SEG).alias("lo"), F.max(_SEG).alias("hi")).first()
        if ends["lo"] is None or ends["lo"] == ends["hi"]:
            break
        levels.append(written(levels[-1].withColumn(_NODE, node).groupBy(e, _NODE).applyInPandas(up, fn_schema), "alert-functions"))
    states = levels[-1].select(e, _SEG, F.lit(_NONE).cast("long").alias("_state"))
    for level in levels[-2::-1]:
        above = states.withColumnRenamed(_SEG, _NODE)
        states = (join_nullsafe(level.withColumn(_NODE, node), above, [e, _NODE], "left")
                  .groupBy(e, _NODE).applyInPandas(down, st_schema))
    return states, rows


def alert_payload(alerts: DataFrame, spec: PanelSpec, prob: str = "failure_probability",
                  level: str = "risk_level") -> DataFrame:
    """Alert card: entity, probability, band and a JSON payload (``to_json``)."""
    body = F.struct(F.col(spec.entity).alias("serial_number"), F.col(spec.time).alias("timestamp"),
                    F.col(prob).alias("failure_probability"), F.col(level).alias("risk_level"))
    return alerts.select(spec.entity, spec.time, prob, level, F.to_json(body).alias("payload"))


def stream_alerts(stream: DataFrame, spec: PanelSpec, cooldown_minutes: float) -> DataFrame:
    """Streaming form: per entity state = last sent time (epoch microseconds)."""
    cooldown = int(round(cooldown_minutes * 60 * 1_000_000))
    ent, tcol = spec.entity, spec.time
    out_schema = T.StructType([stream.schema[spec.entity], stream.schema[spec.time]])
    state_schema = T.StructType([T.StructField("last_us", T.LongType())])

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values(tcol, kind="mergesort")
        last = int(state.get[0]) if state.exists else None
        times = pdf[tcol].to_numpy(dtype="datetime64[us]").astype("int64")
        mask, last = _fold(times, cooldown, last)
        if mask.any():
            state.update((int(last),))
        yield pdf.loc[mask, [ent, tcol]]

    return (stream.select(spec.entity, spec.time).groupBy(spec.entity)
            .applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout))
