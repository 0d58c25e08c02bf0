"""Cleaning: NaN -> NULL, fills, time-weighted interpolation, outlier treatment.

Fills never cross entities.  Scans run inside ``(entity, segment)`` windows and take the
value carried from neighbouring segments (``Layout.carry``), so a hot entity is not one
task.  Backward scans use a descending window with an unbounded *preceding* frame (an
unbounded *following* frame is re-evaluated per row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, epoch_seconds, nan_to_null
from ..plans.segments import layout
from ..spec import PanelSpec
from .quality import SIGMA, bounds_struct


def nan_as_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """S3: NaN counts as missing; turn it into NULL once, at load."""
    cs = {c for c in cols if dict(df.dtypes)[c] in ("double", "float")}
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in cs else F.col(c) for c in df.columns])


def _scan(df: DataFrame, spec: PanelSpec, measures: list[str]):
    """Previous and next non-null (value, time) of each measure, per row."""
    lay = layout(df, spec, 0)
    t = epoch_seconds(spec.time)
    framed = lay.df
    fwd = lay.window().rowsBetween(Window.unboundedPreceding, 0)
    bwd = lay.window(descending=True).rowsBetween(Window.unboundedPreceding, 0)
    pair = {m: F.when(F.col(m).isNotNull(), F.struct(F.col(m).cast("double").alias("v"),
                                                      t.alias("t"))) for m in measures}
    framed = lay.carry(framed, {f"_cp_{m}": pair[m] for m in measures}, forward=True)
    framed = lay.carry(framed, {f"_cn_{m}": pair[m] for m in measures}, forward=False)
    cols = []
    for m in measures:
        cols += [F.coalesce(F.last(pair[m], ignorenulls=True).over(fwd), F.col(f"_cp_{m}")).alias(f"_p_{m}"),
                 F.coalesce(F.last(pair[m], ignorenulls=True).over(bwd), F.col(f"_cn_{m}")).alias(f"_n_{m}")]
    scanned = framed.select("*", *cols)
    return lay, scanned, t


def impute(df: DataFrame, spec: PanelSpec, measures: list[str] | None = None, *,
           interpolate: bool = True, ffill: bool = True, bfill: bool = True,
           zero: bool = True) -> DataFrame:
    """IMP1 / S1: time-weighted linear interpolation inside gaps, then forward fill
    (trailing), backward fill (leading), then 0.  Each stage can be switched off; with
    only ``ffill`` (``bfill``) this is WIN11 (WIN12).  Columns without gaps are unchanged.
    """
    measures = spec.present(df) if measures is None else measures
    lay, s, t = _scan(nan_as_null(df, measures), spec, measures)
    out = {}
    for m in measures:
        x, p, n = F.col(m).cast("double"), F.col(f"_p_{m}"), F.col(f"_n_{m}")
        filled = x
        if interpolate:
            # neighbours at one time: the previous value (no time passes between them)
            inner = F.when(n["t"] == p["t"], p["v"]).otherwise(
                p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"]))
            filled = F.coalesce(filled, F.when(p.isNotNull() & n.isNotNull(), inner))
        if ffill:
            filled = F.coalesce(filled, p["v"])
        if bfill:
            filled = F.coalesce(filled, n["v"])
        if zero:
            filled = F.coalesce(filled, F.lit(0.0))
        out[m] = filled
    s = s.select(*[out[c].alias(c) if c in out else F.col(c) for c in s.columns])
    return lay.finish(s)


def forward_fill(df, spec, measures=None):
    return impute(df, spec, measures, interpolate=False, ffill=True, bfill=False, zero=False)


def backward_fill(df, spec, measures=None):
    return impute(df, spec, measures, interpolate=False, ffill=False, bfill=True, zero=False)


def interpolate(df, spec, measures=None):
    return impute(df, spec, measures, interpolate=True, ffill=False, bfill=False, zero=False)


def clip_outliers(df: DataFrame, cols: list[str], k: float = SIGMA, fit_on: DataFrame | None = None) -> DataFrame:
    """OUT1 clip: into the ``mean +- k std`` bounds of ``fit_on`` (default ``df``); NULL stays
    NULL (S5)."""
    b = bounds_struct(df if fit_on is None else fit_on, cols, k)
    cs = set(cols)
    return df.select(*[clip(F.col(c), b[f"lo__{c}"], b[f"hi__{c}"]).alias(c) if c in cs
                       else F.col(c) for c in df.columns])


def log_transform(df: DataFrame, cols: list[str]) -> DataFrame:
    """OUT1 log: ``log1p`` (NULL for x <= -1)."""
    cs = set(cols)
    return df.select(*[F.log1p(F.col(c)).alias(c) if c in cs else F.col(c) for c in df.columns])


def remove_outliers(df: DataFrame, cols: list[str], k: float = SIGMA, fit_on: DataFrame | None = None) -> DataFrame:
    """OUT2: keep rows whose every value is inside the bounds (of ``fit_on``) or NULL."""
    b = bounds_struct(df if fit_on is None else fit_on, cols, k)
    keep = F.lit(True)
    for c in cols:
        x = F.col(c)
        keep = keep & (x.isNull() | x.between(b[f"lo__{c}"], b[f"hi__{c}"]))
    return df.filter(keep)


def handle_outliers(df: DataFrame, cols: list[str], method: str = "clip", k: float = SIGMA,
                    fit_on: DataFrame | None = None) -> DataFrame:
    ops = {"clip": lambda: clip_outliers(df, cols, k, fit_on), "log": lambda: log_transform(df, cols),
           "remove": lambda: remove_outliers(df, cols, k, fit_on)}
    if method not in ops:
        raise ValueError(f"unknown outlier method {method!r}; expected one of {sorted(ops)}")
    return ops[method]()
