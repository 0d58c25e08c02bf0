"""Report flattening (SRC5), incremental features (STR1), alerts (STR3), stream scoring (STR2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import scale, sketches
from ..sources.reports import parse_reports, to_reports
from ..sources.tables import EVENT_SPEC, event_panel
from ..plans.materialize import written
from ..streaming.alert_stream import replay
from ..streaming.alerts import cooldown_alerts
from ..streaming import saved_state
from ..streaming.incremental import fresh_dir, incremental_features, latest_scores, score_stream
from . import register
from .common import E, P1, TS, rounded, sql_frame, sql_r6, sql_w  # noqa: F401
from .scoring import P3, scored


@register("flatten_report", f"{P1} SELECT {E}, {TS}, 'UNKNOWN' AS model, CAST(0 AS BIGINT) AS capacity_bytes, "
          "CAST(n_events AS DOUBLE) AS smart_5_raw, CAST(round(m_purchase * 100) AS DOUBLE) AS smart_187_raw, "
          "CAST(NULL AS DOUBLE) AS smart_1_raw FROM p")
def flatten_report(spark, sf_dir):
    """P1 rows -> JSON device reports (ids 5, 187 and an unknown 999) -> flat readings."""
    p = event_panel(spark, sf_dir)
    lines = to_reports(p, {5: F.col("n_events"), 187: F.round(F.col("m_purchase") * 100),
                           999: F.col("failure")})
    readings, _rejected = parse_reports(lines)
    return readings.select(E, "timestamp", "model", "capacity_bytes", "smart_5_raw", "smart_187_raw", "smart_1_raw")


_GROUPS = [fe.rolling(("mean", "std"), (7, 30)), fe.deltas((30,)), fe.lags((1, 7)), fe.slope(7, 3)]
_INC_COLS = (["m_value_mean_7d", "m_value_std_7d", "m_value_mean_30d", "m_value_std_30d", "m_value_delta_30d",
              "m_value_lag_1d", "m_value_lag_7d", "m_value_slope_7d"])
_INC_SQL = (f"{P1}, r AS (SELECT *, CAST(row_number() {sql_w()} AS DOUBLE) AS rn FROM p), "
            f"f AS (SELECT {E}, {TS}, m_value, "
            f"coalesce(avg(m_value) {sql_frame(7)}, 0) AS m_value_mean_7d, coalesce(stddev_samp(m_value) {sql_frame(7)}, 0) AS m_value_std_7d, "
            f"coalesce(avg(m_value) {sql_frame(30)}, 0) AS m_value_mean_30d, coalesce(stddev_samp(m_value) {sql_frame(30)}, 0) AS m_value_std_30d, "
            f"coalesce(m_value - lag(m_value, 30) {sql_w()}, 0) AS m_value_delta_30d, "
            f"coalesce(lag(m_value, 1) {sql_w()}, 0) AS m_value_lag_1d, coalesce(lag(m_value, 7) {sql_w()}, 0) AS m_value_lag_7d, "
            f"CASE WHEN count(m_value) {sql_frame(7)} >= 3 THEN coalesce(regr_slope(m_value, rn) {sql_frame(7)}, 0) ELSE 0 END AS m_value_slope_7d "
            f"FROM r) SELECT {E}, {TS}, {sql_r6('m_value')} AS m_value, " + ", ".join(f"{sql_r6(c)} AS {c}" for c in _INC_COLS)
            + f" FROM f WHERE {TS} >= (SELECT max({TS}) - INTERVAL 2 DAY FROM p)")


@register("incremental_features", _INC_SQL)
def incremental(spark, sf_dir):
    """Features of the last three days computed from those rows plus the last 30 rows of
    each entity's history; must equal the full computation restricted to those days."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value")
    cut = p.select(F.max("timestamp") - F.expr("INTERVAL 2 DAYS")).scalar()
    hist, new = p.filter(F.col("timestamp") < cut), p.filter(F.col("timestamp") >= cut)
    out = incremental_features(hist, new, EVENT_SPEC, _GROUPS, measures=["m_value"])
    return rounded(out.select(E, "timestamp", "m_value", *_INC_COLS))


_COOLDOWN_MIN = 2 * 24 * 60
_ALERT_SQL = (P3 + f", a AS (SELECT {E}, {TS}, failure_probability, row_number() {sql_w()} AS rn FROM b WHERE risk_level = 'high'), "
              f"r AS (SELECT {E}, rn, {TS} AS last_sent, TRUE AS sent FROM a WHERE rn = 1 "
              f"UNION ALL SELECT a.{E}, a.rn, CASE WHEN a.{TS} - r.last_sent >= INTERVAL {_COOLDOWN_MIN} MINUTE THEN a.{TS} ELSE r.last_sent END, "
              f"a.{TS} - r.last_sent >= INTERVAL {_COOLDOWN_MIN} MINUTE FROM r JOIN a ON a.{E} = r.{E} AND a.rn = r.rn + 1) "
              f"SELECT a.{E}, a.{TS}, {sql_r6('a.failure_probability')} AS failure_probability FROM r JOIN a USING ({E}, rn) WHERE r.sent")
_ALERT_SQL = _ALERT_SQL.replace("WITH p AS", "WITH RECURSIVE p AS", 1)


@register("alert_cooldown", _ALERT_SQL)
def alert_cooldown(spark, sf_dir):
    """High-risk rows of the fixed scores, one alert per disk per two days at most."""
    s = scored(spark, sf_dir).filter(F.col("risk_level") == "high")
    sent = cooldown_alerts(s, EVENT_SPEC, _COOLDOWN_MIN)
    return rounded(sent.select(E, "timestamp", "failure_probability"))


@register("stream_scores")
def stream_scores(spark, sf_dir):
    """P1 split into one Parquet file per day, read back as a file stream (availableNow);
    each micro-batch gets incremental features against the stored history and fixed
    scores.  Rows-only check: one scored row per panel row."""
    p = event_panel(spark, sf_dir)
    base = fresh_dir(spark, "stream")
    src = f"{base}/input"
    p.withColumn("day", F.to_date("timestamp")).repartition("day").write.partitionBy("day").parquet(src)
    schema = spark.read.parquet(src).schema

    def score(feats):
        z = F.lit(-3.0) + F.lit(0.02) * F.col("m_value") + F.lit(0.7) * F.col("n_events")
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return feats.select(E, "timestamp", "m_value_mean_7d", prob.alias("failure_probability"))

    score_stream(spark, src, schema, EVENT_SPEC, [fe.rolling(("mean",), (7,))], score,
                 f"{base}/scores", f"{base}/context", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/scores").drop("batch")


@register("stream_alerts", _ALERT_SQL)
def stream_alerts(spark, sf_dir):
    """STR3 as a stream: the high-risk rows arrive in five files, up to two days late, and a far row
    of another disk moves the watermark past them; the same alerts as ``alert_cooldown``."""
    s = scored(spark, sf_dir).filter(F.col("risk_level") == "high").select(E, "timestamp", "failure_probability")
    s = s.withColumn("arrival", F.unix_date(F.to_date("timestamp")) + F.pmod(F.xxhash64(E, "timestamp"), F.lit(3)).cast("int"))
    base, n = fresh_dir(spark, "alert-stream"), 5
    s = written(s, "alert-arrivals")
    lo, hi = s.agg(F.min("arrival"), F.max("arrival")).first()
    rows = s.drop("arrival")
    if lo is not None:
        part = F.least(F.floor((F.col("arrival") - lo) * n / F.lit(hi - lo + 1)), F.lit(n - 1))
        for i in range(n):  # one after another: the source takes files by age
            s.filter(part == i).drop("arrival").repartition(1).write.parquet(f"{base}/in/part{i}")
        for i, days in enumerate((400, 800)):
            end = spark.range(1).select(F.lit("end").alias(E), F.date_add(F.lit("1970-01-01").cast("date"), hi + days)
                                        .cast("timestamp_ntz").alias("timestamp"), F.lit(0.0).alias("failure_probability"))
            end.write.parquet(f"{base}/in/x{i}")
        replay(spark, f"{base}/in", rows.schema, EVENT_SPEC, _COOLDOWN_MIN, f"{base}/out", f"{base}/checkpoint", "3 days", 1)
        rows = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out").filter(F.col(E) != "end")
    return rounded(rows.select(E, "timestamp", "failure_probability"))


_STATE_W = (7, 14)
_STATE_SQL = (
    f"{P1}, q AS (SELECT {E}, quantile_cont(m_value, 0.9) AS t FROM p GROUP BY {E}), "
    "z AS (SELECT avg(m_value) AS mu, stddev_samp(m_value) AS sd, min(m_value) AS lo, max(m_value) AS hi FROM p), "
    f"f AS (SELECT p.{E}, p.{TS}, m_value, " + ", ".join(
        f"CASE WHEN count(*) {sql_frame(w).replace('PARTITION BY ' + E, 'PARTITION BY p.' + E)} >= {w} "
        f"THEN CAST(sum(CASE WHEN m_value > t THEN 1 ELSE 0 END) {sql_frame(w).replace('PARTITION BY ' + E, 'PARTITION BY p.' + E)} AS DOUBLE) ELSE 0.0 END AS m_value_spike_{w}d"
        for w in _STATE_W) + f" FROM p JOIN q ON p.{E} = q.{E}) "
    f"SELECT {E}, {TS}, {', '.join(f'm_value_spike_{w}d' for w in _STATE_W)}, {sql_r6('(m_value - mu) / sd')} AS m_value_z, "
    f"{sql_r6('(m_value - lo) / (hi - lo)')} AS m_value_unit, {sql_r6('least(greatest(m_value, mu - 3 * sd), mu + 3 * sd)')} AS m_value_clip "
    f"FROM f, z WHERE {TS} >= (SELECT max({TS}) - INTERVAL 2 DAY FROM p)")


@register("incremental_state", _STATE_SQL)
def incremental_state(spark, sf_dir):
    """STR1 with saved statistics: two older increments leave their state; the last three days get spike
    counts, scaling and clipping as if the whole history had been read."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value")
    last = p.select(F.max("timestamp")).scalar()
    days = F.datediff(F.to_date(last), F.to_date("timestamp"))
    new, hist, m = p.filter(days <= 2), p.filter(days > 2), ["m_value"]
    parts = [written(saved_state.state_of(p.filter(c), EVENT_SPEC, m), "state") for c in (days > 10, (days > 2) & (days <= 10))]
    state = written(saved_state.merged(EVENT_SPEC, *parts), "state")
    out = incremental_features(hist, new, EVENT_SPEC, [fe.spikes(_STATE_W, 0.9)], m, state)
    whole = written(saved_state.merged(EVENT_SPEC, state, saved_state.state_of(new, EVENT_SPEC, m)), "state")
    z = scale.transform_zscore(out, saved_state.zscore_stats(whole, m), m, True).withColumnRenamed("m_value_scaled", "m_value_z")
    unit = scale.transform_minmax(z, saved_state.minmax_stats(whole, m), m, True).withColumnRenamed("m_value_scaled", "m_value_unit")
    clip = saved_state.clipped(unit, whole, m).withColumnRenamed("m_value", "m_value_clip")
    return rounded(clip.select(E, "timestamp", *[f"m_value_spike_{w}d" for w in _STATE_W], "m_value_z", "m_value_unit", "m_value_clip"))


_LATE_SQL = (f"{P1}, f AS (SELECT {E}, {TS}, avg(m_value) {sql_frame(7)} AS m_value_mean_7d, "
             "1.0 / (1.0 + exp(-(CAST(-3.0 AS DOUBLE) + CAST(0.02 AS DOUBLE) * m_value + CAST(0.7 AS DOUBLE) * n_events))) AS failure_probability FROM p) "
             f"SELECT {E}, {TS}, {sql_r6('m_value_mean_7d')} AS m_value_mean_7d, {sql_r6('failure_probability')} AS failure_probability FROM f")


@register("restated_scores", _LATE_SQL)
def restated_scores(spark, sf_dir):
    """STR2 with late rows: readings arrive in four files, up to three days late; rows that follow a late
    one are scored anew, and the last word on each row is that of the full table."""
    p = event_panel(spark, sf_dir).select(E, "timestamp", "m_value", "n_events")
    p = written(p.withColumn("arrival", F.unix_date(F.to_date("timestamp")) + F.pmod(F.xxhash64(E, "timestamp"), F.lit(4)).cast("int")), "arrivals")
    base, n = fresh_dir(spark, "late"), 4
    lo, hi = p.agg(F.min("arrival"), F.max("arrival")).first()
    rows = p.drop("arrival")

    def score(feats):
        z = F.lit(-3.0) + F.lit(0.02) * F.col("m_value") + F.lit(0.7) * F.col("n_events")
        return feats.select(E, "timestamp", "m_value_mean_7d", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("failure_probability"), "replaced")

    schema = f"{E} string, timestamp timestamp_ntz, m_value_mean_7d double, failure_probability double, replaced boolean"
    if lo is None:
        return spark.createDataFrame([], schema).drop("replaced")
    part = F.least(F.floor((F.col("arrival") - lo) * n / F.lit(hi - lo + 1)), F.lit(n - 1))
    for i in range(n):
        p.filter(part == i).drop("arrival").repartition(1).write.mode("append").parquet(f"{base}/in")
    score_stream(spark, f"{base}/in", rows.schema, EVENT_SPEC, [fe.rolling(("mean",), (7,))], score,
                 f"{base}/scores", f"{base}/context", f"{base}/checkpoint", 1, "5 days", restate=True)
    full = spark.createDataFrame([], schema).schema
    return rounded(latest_scores(spark, f"{base}/scores", full, EVENT_SPEC).select(E, "timestamp", "m_value_mean_7d", "failure_probability"))


_KLL_Q = (0.1, 0.25, 0.5, 0.75, 0.9)
_KLL_SQL = (f"{P1}, w AS (SELECT * FROM p WHERE CAST({TS} AS DATE) > (SELECT max(CAST({TS} AS DATE)) - 14 FROM p)), "
            + "v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) AS n FROM w" for m in ("m_value", "m_error")) + ") "
            "SELECT measure, CAST(q AS DOUBLE) AS q, n, TRUE AS within FROM v, (VALUES " + ", ".join(f"({q})" for q in _KLL_Q) + ") t(q)")


@register("kll_quantiles", _KLL_SQL)
def kll_quantiles(spark, sf_dir):
    """AGG9, approximate: daily sketches merged over the last 14 days; each answer's true rank among the
    window's rows is within the sketch's error."""
    p, measures = event_panel(spark, sf_dir), ["m_value", "m_error"]
    days = written(sketches.daily(p, EVENT_SPEC, measures), "sketches")
    last = days.agg(F.max("day")).first()[0]
    if last is None:
        return spark.createDataFrame([], "measure string, q double, n bigint, within boolean")
    got = sketches.quantiles(sketches.window(days, F.date_sub(F.lit(last), 13), F.lit(last)), list(_KLL_Q))
    rows = p.filter(F.to_date("timestamp") >= F.date_sub(F.lit(last), 13)).select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures])).alias("_s")).select("_s.*").filter("x is not null")
    true = rows.join(F.broadcast(got), "measure").groupBy("measure", "q", "n").agg(  # ten answers
        F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    eps = F.lit(sketches.rank_error()) * F.col("n") + 1
    q = F.col("q") * F.col("n")
    return true.select("measure", "q", "n", ((F.col("below") <= q + eps) & (F.col("upto") >= q - eps)).alias("within"))
