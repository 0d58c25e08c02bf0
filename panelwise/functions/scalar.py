"""Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk-band thresholds (exclusive lower bounds) and band names.
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4
BANDS = ("high", "medium", "low")

# Advice text shown for each band.
ADVICE = {
    "high": "Back up data and replace the disk now",
    "medium": "Watch closely and plan a replacement",
    "low": "Healthy, keep monitoring",
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Relative nudge applied before rounding: far above float error (~1e-16), far below the
# rounding unit, so exact decimal ties and last-bit differences round the same way.
NUDGE = 1.0000000000001


# Magnitude up to which comparison keeps 6 decimals; above it, the 24 bits of a float (7 digits).
# The oracle SQL (catalog.common) uses the same formula.
ROUND_BELOW = 100.0


def r6(c) -> Column:
    """Round for comparison: 6 decimals below ``ROUND_BELOW``, single precision above, in plain
    IEEE arithmetic (cheap, two branches, and bit-identical in any engine that evaluates the
    same formula).  NaN and infinities pass through.  ``+ 0.0`` folds -0.0 into 0.0."""
    x = col(c)
    y = x * F.lit(NUDGE)
    small = F.floor(y * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    return F.when(F.abs(x) < F.lit(ROUND_BELOW), small).otherwise(y.cast("float").cast("double")) + F.lit(0.0)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def is_missing(c) -> Column:
    c = col(c)
    return c.isNull() | F.isnan(c)


def clip(c, lo, hi) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (``least``/``greatest`` alone skip NULL)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, col(lo)), col(hi)))


def safe_log1p(c) -> Column:
    return F.log1p(col(c))


def band(p, high: float = HIGH_RISK, medium: float = MEDIUM_RISK) -> Column:
    """high if p > high, medium if p > medium, else low (p = 0 is low)."""
    p = col(p)
    return (F.when(p > high, F.lit(BANDS[0]))
            .when(p > medium, F.lit(BANDS[1]))
            .when(p.isNotNull(), F.lit(BANDS[2])))


def decision(p, threshold: float = 0.5) -> Column:
    """Scoring decision ``p > t`` (strict)."""
    return (col(p) > threshold).cast("int")


def percent_text(p) -> Column:
    return F.format_string("%.0f%%", col(p) * 100)


def advice(band_col) -> Column:
    b = col(band_col)
    expr = F.lit(None).cast("string")
    for k in reversed(BANDS):
        expr = F.when(b == k, F.lit(ADVICE[k])).otherwise(expr)
    return expr


def rule_label(c, limit: float = 100.0) -> Column:
    return (col(c) > limit).cast("int")


def mask(c, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256)


def epoch_seconds(c) -> Column:
    """Seconds since 1970-01-01 of a wall-clock timestamp, independent of session time zone."""
    c = col(c)
    return (F.unix_date(F.to_date(c)).cast("double") * 86400.0
            + F.hour(c) * 3600.0 + F.minute(c) * 60.0
            + F.date_part(F.lit("SECOND"), c).cast("double"))


def day_number(c) -> Column:
    return F.unix_date(F.to_date(col(c)))


def slot_number(c, unit_seconds: int) -> Column:
    """Index of the ``unit_seconds``-long wall-clock slot holding ``c`` (days for 86400)."""
    if unit_seconds == 86_400:
        return day_number(c).cast("long")
    return F.floor(epoch_seconds(c) / F.lit(float(unit_seconds))).cast("long")
