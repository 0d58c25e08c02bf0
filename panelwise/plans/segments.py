"""Skew-safe layout of a panel for per-entity window work.

A window partitioned by entity puts every row of one entity in one task.  When one
entity holds a large share of the rows (a third of the table, say) that task is the
whole job.  ``layout`` finds entities above ``spec.hot_rows`` rows and cuts each of
them into time segments of about ``hot_rows`` rows, by the running count of its rows per
time slot (so a burst is cut as finely as it is dense; slots shorten from days to hours,
minutes and seconds while one holds more than ``hot_rows`` rows).  Windows then partition by
``(entity, segment)``:

* bounded look-back (rolling frames, lags, deltas, slopes) is exact because every
  segment also receives, as *context* rows, enough of the immediately preceding rows
  (at least ``lookback``).  Context rows feed the frames and are dropped afterwards;
* unbounded scans (forward / backward fill, interpolation) combine a scan inside the
  segment with a value carried over from neighbouring segments (``carry``), computed
  on the small per-segment summary.

Entities below the threshold keep segment 0, so for them the plan is the plain
``partitionBy(entity)`` window.  When no entity is hot the helper columns are not
added at all and the plan is exactly the plain one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import slot_number
from ..spec import PanelSpec
from .broadcast import bounded
from .joins import join_nullsafe

SEG, CTX, DAY, HOT = "_seg", "_ctx", "_day", "_hot"
#: Slot lengths tried, in seconds, when one slot of a hot entity holds too many rows.
_SLOTS = (86_400, 3_600, 60, 1)
_HOT_COLLECT_LIMIT = 10_000


def hot_entities(df: DataFrame, spec: PanelSpec) -> DataFrame | None:
    """Entities with more than ``spec.hot_rows`` rows.

    The per-entity count is a partial (map-side) aggregation.  The result has at most
    ``rows / hot_rows`` entries; up to ``_HOT_COLLECT_LIMIT`` of them are brought back as
    a small local table (so the count is not recomputed), above that the frame is
    broadcast after a size check.
    """
    if spec.hot_rows is None:
        return None
    e = spec.entity
    stats = (df.groupBy(e).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > F.lit(spec.hot_rows)).select(e, F.lit(True).alias(HOT)))
    rows = stats.limit(_HOT_COLLECT_LIMIT + 1).collect()
    if not rows:
        return None
    if len(rows) <= _HOT_COLLECT_LIMIT:
        return F.broadcast(df.sparkSession.createDataFrame(rows, stats.schema))
    # many hot entities: still at most rows / hot_rows of them, broadcast behind a size
    # check so the layout join does not shuffle the data by entity
    return bounded(stats)[0]


@dataclass
class Layout:
    df: DataFrame
    spec: PanelSpec
    part: list[str]
    hot: DataFrame | None
    columns: list[str]

    def window(self, descending: bool = False) -> Window:
        order = [F.col(c).desc() if descending else F.col(c) for c in self.spec.order]
        return Window.partitionBy(*self.part).orderBy(*order)

    def finish(self, df: DataFrame, extra: list[str] | None = None) -> DataFrame:
        """Drop context rows and helper columns; keep input columns then ``extra``."""
        if self.hot is not None:
            df = df.filter(~F.col(CTX))
        keep = self.columns + [c for c in (extra or []) if c not in self.columns]
        return df.select(*keep)

    def carry(self, df: DataFrame, values: dict[str, Column], *, forward: bool = True) -> DataFrame:
        """Join, for hot segments, the last (``forward``) or first non-null value of each
        expression in the segments before (after) the row's own segment.

        ``values`` maps an output name to an expression evaluated on main rows.  For
        rows of non-hot entities the carried columns are NULL.
        """
        if self.hot is None:
            types = {k: df.select(v).schema[0].dataType for k, v in values.items()}
            return df.select("*", *[F.lit(None).cast(types[k]).alias(k) for k in values])
        e = self.spec.entity
        main = df.filter(~F.col(CTX) & F.col(HOT))
        order_key = F.struct(*[F.col(c) for c in self.spec.order])
        aggs = []
        for k, v in values.items():
            pick = F.max_by if forward else F.min_by
            aggs.append(pick(v, F.when(v.isNotNull(), order_key)).alias(k))
        summary = main.groupBy(e, SEG).agg(*aggs)
        w = Window.partitionBy(e).orderBy(F.col(SEG) if forward else F.col(SEG).desc())
        prior = w.rowsBetween(Window.unboundedPreceding, -1)
        summary = summary.select(e, SEG, *[F.last(k, ignorenulls=True).over(prior).alias(k)
                                           for k in values])
        small, _ = bounded(summary)
        return join_nullsafe(df, small, [e, SEG], "left")


_UNSET = object()


def _slot_seconds(marked: DataFrame, spec: PanelSpec) -> int:
    """The longest slot, not above the configured one, in which no hot entity has more than
    ``hot_rows`` rows (seconds where none is short enough)."""
    for seconds in [spec.segment_seconds, *[s for s in _SLOTS if s < spec.segment_seconds]]:
        per = marked.filter(HOT).groupBy(spec.entity, slot_number(spec.time, seconds).alias(DAY)).count()
        if (per.agg(F.max("count")).first()[0] or 0) <= spec.hot_rows:
            return seconds
    return seconds


def layout(df: DataFrame, spec: PanelSpec, lookback: int = 0, lookback_days: int = 0,
           hot=_UNSET) -> Layout:
    """Lay ``df`` out for windows over ``(entity, segment)``.

    ``lookback`` is the largest number of preceding rows any bounded expression reads
    (e.g. 29 for a 30-row frame, 30 for ``lag(x, 30)``); ``lookback_days`` the same for
    calendar frames.  ``hot`` may be passed when already computed on the same rows.
    """
    columns = list(df.columns)
    if hot is _UNSET:
        hot = hot_entities(df, spec)
    if hot is None:
        return Layout(df, spec, [spec.entity], None, columns)
    e = spec.entity
    marked = join_nullsafe(df, hot, [e], "left").withColumn(HOT, F.coalesce(HOT, F.lit(False)))
    if not lookback_days:  # calendar frames need segments that end with a day
        spec = spec.with_(segment_seconds=_slot_seconds(marked, spec))
    marked = marked.withColumn(DAY, slot_number(spec.time, spec.segment_seconds))
    # rows of hot entities per slot: small; a segment is a run of slots of about hot_rows rows
    slots = marked.filter(HOT).groupBy(e, DAY).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(e).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    slots, _ = bounded(slots.select(e, DAY, F.floor(F.coalesce(F.sum("_c").over(upto), F.lit(0)) / F.lit(spec.hot_rows))
                                    .cast("int").alias(SEG)))
    base = (join_nullsafe(marked, slots, [e, DAY], "left").withColumn(SEG, F.coalesce(SEG, F.lit(0)))
            .withColumn(CTX, F.lit(False)).select(*columns, DAY, HOT, SEG, CTX))
    if lookback > 0 or lookback_days > 0:
        # calendar look-back in slots; a sub-day slot may start mid-day: one day of slack
        extra = 0 if spec.segment_seconds == 86_400 else 1
        slots = -(-(lookback_days + extra) * 86_400 // spec.segment_seconds) if lookback_days else 0
        base = base.unionByName(_context_rows(base, spec, lookback, slots))
    return Layout(base, spec, [e, SEG], hot, columns)


def _context_rows(base: DataFrame, spec: PanelSpec, lookback: int, lookback_days: int) -> DataFrame:
    """Rows of hot entities copied into the following segment(s) as look-back context.

    Works on the per-(entity, day) counts of hot entities only (small).  For segment
    s' starting at day st, context begins at the latest day d whose preceding row
    count ``cb(d)`` is at most ``cb(st) - lookback`` (all history when fewer rows
    exist).  Whole days are copied, so at least ``lookback`` rows precede every
    main row of s'; extra earlier rows do not change row frames.  Calendar frames
    need the days ``[st - lookback_days, st)``; the earlier of both starts is used.
    """
    e = spec.entity
    hot_rows = base.filter(HOT)
    days = hot_rows.groupBy(e, DAY, SEG).agg(F.count(F.lit(1)).alias("_c"))
    w_day = Window.partitionBy(e).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_cb", F.coalesce(F.sum("_c").over(w_day), F.lit(0)).cast("long"))
    segs = (days.groupBy(e, SEG)
            .agg(F.min("_cb").alias("_cbst"), F.min(DAY).alias("_st"))
            .withColumn("_need", F.col("_cbst") - F.lit(lookback)))

    def ordered_last(u: DataFrame, value: str) -> Column:
        w = (Window.partitionBy(e).orderBy("_k", "_kind", "_o")
             .rowsBetween(Window.unboundedPreceding, 0))
        return F.last(value, ignorenulls=True).over(w)

    # context start per segment: latest day with cb <= need
    u = (days.select(e, F.col("_cb").alias("_k"), F.lit(0).alias("_kind"), F.col(DAY).alias("_o"),
                     F.col(DAY).alias("_d"), F.lit(None).cast("int").alias(SEG))
         .unionByName(segs.select(e, F.col("_need").alias("_k"), F.lit(1).alias("_kind"),
                                  F.lit(0).alias("_o"), F.lit(None).cast("long").alias("_d"), SEG)))
    u = join_nullsafe(u, segs.select(e, SEG, "_st"), [e, SEG], "left")
    by_rows = (F.coalesce(F.col("_cs"), F.lit(-(2 ** 62))) if lookback > 0
               else F.lit(2 ** 62))
    by_days = (F.col("_st") - F.lit(lookback_days)) if lookback_days > 0 else F.lit(2 ** 62)
    starts = (u.withColumn("_cs", ordered_last(u, "_d"))
              .filter(F.col("_kind") == 1)
              .select(e, SEG, F.least(by_rows, by_days).cast("long").alias("_cs")))
    # for each day: the last segment whose context starts on or before it
    u2 = (starts.select(e, F.col("_cs").alias("_k"), F.lit(0).alias("_kind"),
                        F.col(SEG).alias("_o"), F.col(SEG).alias("_s"),
                        F.lit(None).cast("long").alias(DAY), F.lit(None).cast("int").alias("_own"))
          .unionByName(days.select(e, F.col(DAY).cast("long").alias("_k"), F.lit(1).alias("_kind"),
                                   F.lit(0).alias("_o"), F.lit(None).cast("int").alias("_s"),
                                   DAY, F.col(SEG).alias("_own"))))
    cmap = (u2.withColumn("_smax", ordered_last(u2, "_s"))
            .filter((F.col("_kind") == 1) & (F.col("_smax") > F.col("_own")))
            .select(e, DAY, F.sequence(F.col("_own") + 1, F.col("_smax")).alias("_targets")))
    cmap, _ = bounded(cmap)
    return (join_nullsafe(hot_rows, cmap, [e, DAY])
            .withColumn(SEG, F.explode("_targets"))
            .withColumn(CTX, F.lit(True))
            .select(*base.columns))
