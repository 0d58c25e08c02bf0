"""Scoring helpers (ML20-22, PRJ3, PRJ10, SCA6, SCA9-10, AGG8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import advice, band, decision, percent_text


def align(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """PRJ3: exactly ``features`` in order; missing ones become 0, NULL -> 0, extras dropped."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have
            else F.lit(0.0).alias(c) for c in features]
    return df.select(*[F.col(k) for k in keep], *cols)


def fixed_logistic(intercept: float, weights: dict[str, float]) -> Column:
    """Probability of a fixed linear model (used for P3 scores and as a scoring stand-in)."""
    z = F.lit(float(intercept))
    for c, w in weights.items():
        z = z + F.lit(float(w)) * F.col(c)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_risk(df: DataFrame, prob: str = "failure_probability", threshold: float = 0.5) -> DataFrame:
    """Add prediction (``p > t``), risk band, percent text and advice."""
    return df.select("*", decision(prob, threshold).alias("prediction"),
                     band(prob).alias("risk_level"))


def card(df: DataFrame, prob: str = "failure_probability") -> DataFrame:
    """Display fields of a scored row: percent text and band advice."""
    return df.select("*", percent_text(prob).alias("probability_text"), advice("risk_level").alias("advice"))


def risk_summary(df: DataFrame, prob: str = "failure_probability") -> DataFrame:
    """AGG8: total, high, medium, low."""
    p = F.col(prob)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(p > 0.7).alias("high"),
                  F.count_if((p > 0.4) & (p <= 0.7)).alias("medium"), F.count_if(p <= 0.4).alias("low"))


def days_to_limit(x: Column, slope_per_day: Column, limit: float) -> Column:
    """S21: whole days until the linear trend reaches ``limit``; NULL if not rising or past it."""
    return F.when((slope_per_day > 0) & (x < limit),
                  F.ceil((F.lit(float(limit)) - x) / slope_per_day).cast("long"))


def key_indicators(importances: DataFrame, n: int = 5) -> Column:
    """ML21: names of the top-n features by importance, as one array (scalar subquery)."""
    top = importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
    return top.agg(F.array_sort(F.collect_list(F.struct(-F.col("importance"), F.col("feature"))))
                   .alias("a")).select(F.transform("a", lambda s: s["feature"])).scalar()
