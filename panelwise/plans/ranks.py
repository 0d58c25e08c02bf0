"""Exact ranks, quantiles and running totals over a global order, without one-task windows.

``Window.orderBy(x)`` with no partition, or ``percentile`` on a group that holds a third
of the table, both end in a single task holding everything.  Here the ordered key space
is cut into ``parts`` buckets; each bucket is scanned locally and a tiny per-bucket
summary supplies the offsets.

The bucket of a row must be a pure function of its key (the frame is evaluated more than
once: once for the bucket totals, once for the local scan).  ``repartitionByRange``
samples whatever order rows arrive in, so two evaluations may cut differently; the
bounds here come from a sample chosen by a hash of the key, which is the same every
time.  Callers pass keys that are unique (duplicates aggregated first, with a weight),
so no bucket can hold more than about ``rows / parts`` rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_nullsafe
from .materialize import written

PID = "_pid"
_SAMPLES_PER_PART = 64
_HASH_RANGE = 1 << 30


def _parts(df: DataFrame, parts: int | None) -> int:
    if parts:
        return parts
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _lit(v, dtype) -> Column:
    if isinstance(v, (_dt.datetime, _dt.date)):
        return F.lit(str(v)).cast(dtype)
    return F.lit(v).cast(dtype)


def _less(cols: list[str], types, bound: tuple) -> Column:
    """Lexicographic ``key < bound``; NULL is the smallest value, as in Spark's ascending order."""
    expr = None
    for c, t, b in reversed(list(zip(cols, types, bound))):
        x, lb = F.col(c), _lit(b, t)
        under = x.isNull() | (x < lb)
        expr = under if expr is None else (under | (x.eqNullSafe(lb) & expr))
    return expr


def _bucket(cols, types, bounds, lo, hi) -> Column:
    """Bucket id in [lo, hi] by binary search over ``bounds`` (depth log2(parts))."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_less(cols, types, bounds[mid]), _bucket(cols, types, bounds, lo, mid)).otherwise(
        _bucket(cols, types, bounds, mid + 1, hi))


def bucket_of(df: DataFrame, order: list[str], parts: int | None = None) -> Column:
    """Deterministic range bucket of each row over ``order`` (NULLs first).

    One count and one sample of ``parts * 64`` keys (chosen by key hash) reach the
    driver; the bucket expression is a comparison tree over ``parts - 1`` bounds.
    """
    p = _parts(df, parts)
    keys = df.select(*order)
    n = keys.count()
    if n == 0 or p <= 1:
        return F.lit(0)
    rate = min(1.0, p * _SAMPLES_PER_PART / n)
    h = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(_HASH_RANGE))
    picked = keys.filter(h < F.lit(int(rate * _HASH_RANGE)))
    for c in order:  # bounds are non-null; NULL keys sort before them
        picked = picked.filter(F.col(c).isNotNull())
    sample = sorted(tuple(r) for r in picked.collect())
    if not sample:
        return F.lit(0)
    bounds = []
    for i in range(1, p):
        b = sample[(i * len(sample)) // p]
        if not bounds or b > bounds[-1]:
            bounds.append(b)
    types = [df.schema[c].dataType for c in order]
    return _bucket(order, types, bounds, 0, len(bounds))


def running_totals(df: DataFrame, order: list[str], sums: dict[str, Column],
                   parts: int | None = None) -> DataFrame:
    """Add, for each ``name -> expr`` in ``sums``, the running total of ``expr`` over the
    global ``order`` (current row included, NULLs first, NaN last).  ``order`` should be
    unique per row; callers whose NULL keys have no rank leave them out first."""
    # counted, sampled and summed from the keys and weights alone, written once: the plan behind
    # ``df`` runs twice (here and for the scan), and no other column is written
    keys = written(df.select(*order, *[v.alias(f"_sum_{k}") for k, v in sums.items()]), "ranks")
    bucket = bucket_of(keys, order, parts)
    r = df.withColumn(PID, bucket)
    totals = keys.withColumn(PID, bucket).groupBy(PID).agg(*[F.sum(f"_sum_{k}").alias(k) for k in sums])
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PID, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_off_{k}")
                                   for k in sums])
    # one row per bucket: bounded by the partition count
    offsets = F.broadcast(offsets)
    local = Window.partitionBy(PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.select("*", *[F.sum(v).over(local).alias(f"_loc_{k}") for k, v in sums.items()])
    out = out.join(offsets, PID)
    return out.select(*df.columns, *[(F.col(f"_loc_{k}") + F.col(f"_off_{k}")).alias(k)
                                     for k in sums])


def group_quantiles(df: DataFrame, groups: list[str], value: str, qs: dict[str, float],
                    parts: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles (``quantile_cont`` / ``percentile``) per group.

    NULL and NaN values are ignored; a group with no values is absent from the result.
    Equal values are first counted (partial aggregation), then positions come from a
    bucketed running count that restarts per group.  Output: ``groups`` + one double
    column per entry of ``qs``.  A row stands for ``weight`` (a column) equal ones.
    """
    v = (df.select(*groups, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
         .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    d = v.groupBy(*groups, "_v").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("_c"))
    d = written(d, "ranks")
    r = d.withColumn(PID, bucket_of(d, [*groups, "_v"], parts))
    w = Window.partitionBy(PID, *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    r2 = r.withColumn("_lc", F.sum("_c").over(w))
    # per (bucket, group) totals: at most groups + buckets rows
    tot = r.groupBy(PID, *groups).agg(F.sum("_c").alias("_t"))
    g = Window.partitionBy(*groups)
    tot = (tot.withColumn("_off", F.coalesce(F.sum("_t").over(
                g.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("_n", F.sum("_t").over(g))
           .drop("_t"))
    j = join_nullsafe(r2, tot, [PID, *groups])
    hi = F.col("_off") + F.col("_lc")          # rows with value <= _v in the group
    lo = hi - F.col("_c")                      # rows with value <  _v
    aggs = []
    for i, q in enumerate(qs.values()):
        h = F.lit(float(q)) * (F.col("_n") - 1)
        for end, k in ((0, F.floor(h)), (1, F.ceil(h))):
            aggs.append(F.max(F.when((lo <= k) & (k < hi), F.col("_v"))).alias(f"_x{i}_{end}"))
        aggs.append(F.max(h).alias(f"_h{i}"))
    per = j.groupBy(*groups).agg(*aggs)
    out = []
    for i, name in enumerate(qs):
        x0, x1, h = F.col(f"_x{i}_0"), F.col(f"_x{i}_1"), F.col(f"_h{i}")
        out.append((x0 + (h - F.floor(h)) * (x1 - x0)).alias(name))
    return per.select(*groups, *out)


def global_quantiles(df: DataFrame, value: str, qs: dict[str, float],
                     parts: int | None = None) -> DataFrame:
    """One-row frame of exact quantiles over the whole column (NULLs when empty)."""
    one = group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, parts)
    base = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return base.join(one, "_all", "left").drop("_all")
