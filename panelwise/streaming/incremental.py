"""Incremental feature computation (STR1) and micro-batch scoring (STR2).

New readings need only the last ``lookback`` rows of each entity as context for the
bounded-look-back features (rolling frames, deltas, lags, trends, slope).  The context
is a top-k per entity, which Catalyst plans as a ``WindowGroupLimit`` applied before the
shuffle, so each map task forwards at most k rows per entity.  Calendar frames add the rows
of the days before.  What depends on an entity's whole history (spike thresholds) or on all
rows (clipping, scaling) comes from a saved, mergeable state (``saved_state``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import FeatureGroup, add_features
from ..plans.joins import join_nullsafe
from ..plans.materialize import fresh_dir, shared_dir  # noqa: F401
from ..spec import PanelSpec
from .saved_state import merged, state_of, thresholds

NEW = "_is_new"


def last_rows(df: DataFrame, spec: PanelSpec, k: int) -> DataFrame:
    """The last ``k`` rows of every entity (ties by ``spec.tiebreak``)."""
    w = Window.partitionBy(spec.entity).orderBy(*[F.col(c).desc() for c in spec.order])
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def context_rows(history: DataFrame, new: DataFrame, spec: PanelSpec, k: int, days: int = 0) -> DataFrame:
    """What features of ``new`` need of the history: per entity, the last ``k`` rows before its
    earliest new row, those of the ``days`` before that row's day, and every row from it on (none
    for entities without new rows)."""
    first = new.groupBy(spec.entity).agg(F.min(spec.time).alias("_first"))
    near = join_nullsafe(history, first, [spec.entity])
    older = near.filter(F.col(spec.time) < F.col("_first"))
    recent = F.to_date(spec.time) >= F.date_sub(F.to_date("_first"), days)
    if days:
        before = last_rows(older.filter(~recent), spec, k).unionByName(older.filter(recent))
    else:
        before = last_rows(older, spec, k)
    return before.unionByName(near.filter(F.col(spec.time) >= F.col("_first"))).drop("_first")


def restated(history: DataFrame, new: DataFrame, spec: PanelSpec) -> DataFrame:
    """Keys of history rows after a late new row: their bounded features may have changed."""
    first = new.groupBy(spec.entity).agg(F.min(spec.time).alias("_first"))
    return join_nullsafe(history, first, [spec.entity]).filter(F.col(spec.time) > F.col("_first")).select(*spec.keys)


def incremental_features(history: DataFrame, new: DataFrame, spec: PanelSpec, groups: list[FeatureGroup],
                         measures=None, state: DataFrame | None = None, restate: bool = False) -> DataFrame:
    """Features of the ``new`` rows, equal to a full recomputation over history + new.  New rows may be
    late: the context of an entity is its last ``lookback`` rows (and days) before its *earliest*
    new row, and all its rows after that.

    Spike counts need ``state``, the saved value counts of the history (``saved_state.state_of``); those
    of the new rows are added here.  With ``restate`` the history's rows that follow a late row are
    given too, with their new features, and a flag ``replaced`` tells them from new ones; without it
    they keep the features they had (`restated` gives their keys)."""
    spike_qs = {g.spike_q for g in groups if g.spike_q is not None}
    if spike_qs and state is None:
        raise ValueError("spike counts on increments need the saved state of the history")
    measures = spec.present(new) if measures is None else measures
    thr = None
    if spike_qs:
        (q,) = spike_qs
        mine = new.select(spec.entity).distinct()  # thresholds of the entities with new rows only
        whole = merged(spec, state, state_of(new, spec, measures))
        thr = thresholds(join_nullsafe(whole, mine, [spec.entity], "left_semi"), spec, measures, q)
    k, days = max([g.lookback for g in groups] + [0]), max([g.lookback_days for g in groups] + [0])
    cols = new.columns
    ctx = context_rows(history.select(*cols), new, spec, k, days).withColumn(NEW, F.lit(False))
    both = ctx.unionByName(new.withColumn(NEW, F.lit(True)))
    out = add_features(both, spec, groups, measures, thr)
    if not restate:
        return out.filter(F.col(NEW)).drop(NEW)
    first = new.groupBy(spec.entity).agg(F.min(spec.time).alias("_first"))
    late = join_nullsafe(out, first, [spec.entity]).filter(F.col(NEW) | (F.col(spec.time) > F.col("_first"))).drop("_first")
    return late.withColumn("replaced", ~F.col(NEW)).drop(NEW)


def kept_context(rows: DataFrame, spec: PanelSpec, k: int, late_delay: str) -> DataFrame:
    """Rows a later batch can need: readings up to ``late_delay`` behind the newest one are still
    admitted, so per entity the rows since then and the last ``k`` before."""
    newest = rows.agg(F.max(spec.time)).scalar()
    cut = newest - F.expr(f"INTERVAL {late_delay}")
    old = last_rows(rows.filter(F.col(spec.time) < cut), spec, k)
    return old.unionByName(rows.filter(F.col(spec.time) >= cut))


EVENT_TIME = "_event_time"


def _latest_batch_before(spark: SparkSession, root: str, epoch: int) -> int | None:
    """Largest ``batch=<id>`` directory under ``root`` with id < ``epoch`` (a listing of
    one directory level on the driver; one entry per micro-batch)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    ids = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < epoch:
            ids.append(int(name[6:]))
    return max(ids) if ids else None


def score_stream(spark: SparkSession, source_dir: str, schema, spec: PanelSpec, groups: list[FeatureGroup],
                 score_fn, out_dir: str, context_dir: str, checkpoint_dir: str,
                 max_files: int | None = None, late_delay: str = "1 day", restate: bool = False) -> None:
    """STR2/STR4: file source -> watermark (T+1 by default) and de-duplication of
    re-delivered readings per (entity, time) -> per micro-batch: incremental features
    against a compact context -> ``score_fn`` -> scores.  Runs until the available input
    is processed (``availableNow``).

    The context is only the last ``lookback`` rows of every entity (``context_dir``,
    rewritten per batch), so a batch never rescans the history: its cost follows the
    batch and the fleet size, not the age of the stream.  Each batch writes to its own
    ``batch=<id>`` directories in overwrite mode and reads the newest context older than
    itself, so a retried batch (lost executor or driver restart) gives the same rows.
    With ``restate`` a batch also gives the rows that follow a late one anew (flag ``replaced``, which
    ``score_fn`` must pass on); ``latest_scores`` reads the last word on each row.
    The watermark needs a TIMESTAMP column, so a session-time-zone copy of the
    wall-clock time is used for it and dropped in the batch."""
    k = max(g.lookback for g in groups)

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.drop(EVENT_TIME).persist()
        prev = _latest_batch_before(spark, context_dir, epoch)
        ctx = (spark.read.schema(schema).parquet(f"{context_dir}/batch={prev}") if prev is not None
               else spark.createDataFrame([], schema))
        feats = incremental_features(ctx, df, spec, groups, restate=restate)
        score_fn(feats).write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")
        # rows that may still precede a late one: the last k before the newest time less the delay
        both = ctx.unionByName(df.select(*ctx.columns))
        kept_context(both, spec, k, late_delay).write.mode("overwrite").parquet(f"{context_dir}/batch={epoch}")
        df.unpersist()

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = (reader.parquet(source_dir)
              .withColumn(EVENT_TIME, F.col(spec.time).cast("timestamp"))
              .withWatermark(EVENT_TIME, late_delay)
              .dropDuplicatesWithinWatermark([spec.entity, *spec.keys[1:]]))
    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_scores(spark: SparkSession, out_dir: str, schema, spec: PanelSpec) -> DataFrame:
    """The output of ``score_stream`` with one row for each reading: that of the latest batch.  Batches are
    folders that a retry overwrites, so this is the same after any number of retries."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(full).parquet(out_dir)
    others = [c for c in rows.columns if c not in spec.keys]
    last = rows.groupBy(*spec.keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return last.select(*spec.keys, "_r.*")
