"""Panel description shared by every operator, and the feature-name contract."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns that are never model features (identity, label, partition columns).
NON_FEATURE_COLS = ("failure", "serial_number", "timestamp", "year", "month")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class PanelSpec:
    """One row per (entity, time); measures are the numeric readings.

    ``tiebreak`` orders rows that share a timestamp; leave it empty only when
    (entity, time) is unique.  ``hot_rows`` is the per-entity row count above
    which an entity is split into time segments for window work (skew guard);
    ``None`` turns the guard off.  Segments are runs of slots of ``segment_seconds`` (a day by
    default; shorter ones are taken where a slot holds more than ``hot_rows`` rows).
    """

    entity: str = "serial_number"
    time: str = "timestamp"
    measures: tuple[str, ...] = ()
    label: str | None = "failure"
    tiebreak: tuple[str, ...] = ()
    windows: tuple[int, ...] = (7, 14, 30)
    lags: tuple[int, ...] = (1, 3, 7)
    trend_spans: tuple[int, ...] = (7, 14)
    slope_rows: int = 7
    slope_min_rows: int = 3
    spike_quantile: float = 0.9
    hot_rows: int | None = 1_000_000
    segment_seconds: int = 86_400
    excluded: tuple[str, ...] = field(default=NON_FEATURE_COLS)

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    @property
    def keys(self) -> list[str]:
        return [self.entity, self.time, *self.tiebreak]

    def with_(self, **kw) -> "PanelSpec":
        return replace(self, **kw)

    def present(self, df: DataFrame) -> list[str]:
        """Configured measures that exist in ``df`` (absent ones are skipped)."""
        cols = set(df.columns)
        return [m for m in self.measures if m in cols]

    def feature_columns(self, df: DataFrame) -> list[str]:
        """Numeric columns that are not identity, label, time or partition columns."""
        skip = set(self.excluded) | {self.entity, self.time, *self.tiebreak}
        if self.label:
            skip.add(self.label)
        return [f.name for f in df.schema.fields
                if f.name not in skip and isinstance(f.dataType, NUMERIC_TYPES)]


def feature_names(spec: PanelSpec, measures=None, *, spikes: bool = True,
                  slope: bool = True) -> list[str]:
    """Names produced by the full feature stage, in output order."""
    out: list[str] = []
    for m in measures if measures is not None else spec.measures:
        out.append(m)
        for w in spec.windows:
            out += [f"{m}_{s}_{w}d" for s in ("mean", "max", "min", "std", "delta")]
            if spikes:
                out.append(f"{m}_spike_{w}d")
        out += [f"{m}_lag_{k}d" for k in spec.lags]
        out += [f"{m}_trend_{s}d" for s in spec.trend_spans]
        if slope:
            out.append(f"{m}_slope_{spec.slope_rows}d")
    return out


def catalogue(spark: SparkSession, spec: PanelSpec, measures=None, **kw) -> DataFrame:
    """Feature catalogue as a two-column DataFrame ``(ordinal, feature)``."""
    names = feature_names(spec, measures, **kw)
    schema = T.StructType([T.StructField("ordinal", T.IntegerType(), False),
                           T.StructField("feature", T.StringType(), False)])
    return spark.createDataFrame(list(enumerate(names, 1)), schema)
