"""Connected components of a link table, as Spark joins.

Alternating star contraction: every node's larger neighbours are linked to its smallest
neighbour, then every node's smaller neighbours are, until the links are stars around the
smallest member.  Each round is written to the shared folder; nothing is collected but
whether the links are stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(pairs: DataFrame) -> DataFrame:
    """``(u, v)`` with v < u: link each v, and u itself, to the smallest v of u."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return per.where("up > 1 OR (up = 1 AND root = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) for every node of a link, component = the smallest node reachable."""
    x, y = F.col(a), F.col(b)
    pairs = written(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _settled(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pairs = written(_star(large), "links")
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
