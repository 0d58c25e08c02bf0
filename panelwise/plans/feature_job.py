"""The end-to-end feature stage (PIP1) as one lazy plan.

NaN -> NULL, quality reports, imputation, outlier treatment, window features and
optional scaling, composed with ``DataFrame.transform``-style calls.  Nothing here
runs a job except the small statistics steps (hot-entity check, clip bounds, scaling fit);
the caller's sink triggers the work.  Clip bounds and scaling statistics are fitted on the
rows where ``fit_on`` holds (the training rows) when it is given (S9); with scaling the
feature frame is written once to the shared folder, so the fit does not repeat it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import clean, quality, scale
from ..operators.features import FeatureGroup, add_features, default_groups
from ..spec import PanelSpec
from .materialize import materialize


@dataclass
class FeatureResult:
    features: DataFrame
    missing: DataFrame
    outliers: DataFrame
    scale_stats: DataFrame | None


def build_features(df: DataFrame, spec: PanelSpec, *, outliers: str | None = "clip",
                   groups: list[FeatureGroup] | None = None, scale_method: str | None = None,
                   fit_on: Column | None = None) -> FeatureResult:
    """``fit_on`` is a predicate over the panel's own columns (time, entity, label)."""
    measures = spec.present(df)
    df = clean.nan_as_null(df, measures)
    missing = quality.missing_rate(df, measures)
    outlier_report = quality.outlier_rate(df, measures)
    df = clean.impute(df, spec, measures)
    if outliers:
        df = clean.handle_outliers(df, measures, outliers, fit_on=None if fit_on is None else df.filter(fit_on))
    feats = add_features(df, spec, groups or default_groups(spec), measures)
    stats = None
    if scale_method:
        feats = materialize(feats)
        cols = spec.feature_columns(feats)
        feats, stats = scale.standardize(feats, cols, scale_method, fit_on=None if fit_on is None else feats.filter(fit_on))
    return FeatureResult(feats, missing, outlier_report, stats)
