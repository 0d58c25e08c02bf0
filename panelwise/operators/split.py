"""Train/test splits (SPL1-5, SET1), all deterministic and distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.broadcast import bounded
from ..plans.ranks import running_totals
from ..spec import PanelSpec

SPLIT = "split"


def time_cutoffs(df: DataFrame, spec: PanelSpec, fractions: list[float]) -> DataFrame:
    """One row per fraction f: the smallest time whose cumulative row count reaches f * N (S16)."""
    per_t = df.groupBy(spec.time).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(per_t, [spec.time], {"_cum": F.col("_c")})
    total = per_t.agg(F.sum("_c")).scalar()
    wide = cum.agg(*[F.min(F.when(F.col("_cum") >= F.lit(float(f)) * total, F.col(spec.time)))
                     .alias(f"_c{i}") for i, f in enumerate(fractions)])
    rows = [F.struct(F.lit(i).alias("fold"), F.lit(float(f)).alias("fraction"),
                     F.col(f"_c{i}").alias("cutoff")) for i, f in enumerate(fractions)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def time_split(df: DataFrame, spec: PanelSpec, train_fraction: float = 0.8) -> DataFrame:
    """SPL1: rows up to the cutoff train, the rest test; no tie is cut, nothing de-duplicated."""
    cut = time_cutoffs(df, spec, [train_fraction]).select("cutoff").scalar()
    return df.withColumn(SPLIT, F.when(F.col(spec.time) <= cut, F.lit("train")).otherwise(F.lit("test")))


def random_split(df: DataFrame, weights=(0.8, 0.2), seed: int = 42) -> list[DataFrame]:
    """SPL2 as in Spark (`randomSplit`)."""
    return df.randomSplit(list(weights), seed)


def key_hash(cols: list[str], seed: int = 42) -> Column:
    """Stable text hash of a row key (md5 of ``seed|k1|k2``), comparable across engines."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_split(df: DataFrame, key_cols: list[str], test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """SPL2, reproducible variant: test when the key hash falls in the first fraction."""
    h = F.conv(F.substring(key_hash(key_cols, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(SPLIT, F.when(h < F.lit(int(test_fraction * 16 ** 8)), "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key_cols: list[str], test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """SPL3: per label, the ``round(f * n_label)`` rows with the smallest key hash are test.

    The rank inside a label comes from a range-partitioned running count (no window
    over the label, which would be one task per class).  Unlabelled rows are kept, as
    training rows: no class of theirs could be matched in the test part.
    """
    unlabelled = df.filter(F.col(label).isNull()).select(*df.columns, F.lit("train").alias(SPLIT))
    h = df.filter(F.col(label).isNotNull()).withColumn("_h", key_hash(key_cols, seed))
    per_label = h.groupBy(label).agg(F.count(F.lit(1)).alias("_nl"))
    cum = running_totals(h, [label, "_h"], {"_cum": F.lit(1)})
    start = running_totals(per_label, [label], {"_upto": F.col("_nl")})
    start = start.select(label, "_nl", (F.col("_upto") - F.col("_nl")).alias("_before"))
    start, _ = bounded(start)  # one row per label value, size checked
    out = cum.join(start, label)
    rank = F.col("_cum") - F.col("_before")
    test = rank <= F.round(F.col("_nl") * test_fraction)
    return out.select(*df.columns, F.when(test, "test").otherwise("train").alias(SPLIT)).unionByName(unlabelled)


def fold_column(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """SPL4: fold id by key hash (all rows of a key in one fold) for ``CrossValidator(foldCol=)``."""
    h = F.conv(F.substring(key_hash(key_cols, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, F.pmod(h, F.lit(k)).cast("int"))


def rolling_origin(df: DataFrame, spec: PanelSpec, k: int = 3) -> DataFrame:
    """SPL5: k cutoffs at row-count fractions i/(k+1); fold i trains on time < c_i and
    tests on [c_i, c_{i+1}) (the last fold tests to the end).  Returns
    ``(fold, role, *df columns)``: every row appears once per fold it belongs to."""
    cuts = time_cutoffs(df, spec, [i / (k + 1) for i in range(1, k + 1)])
    nxt = cuts.alias("a").join(cuts.alias("b"), F.col("b.fold") == F.col("a.fold") + 1, "left")
    bounds = nxt.select(F.col("a.fold").alias("fold"), F.col("a.cutoff").alias("lo"),
                        F.col("b.cutoff").alias("hi"))
    t = F.col(spec.time)
    # the k bounds as one scalar array; a row is copied only into the folds it belongs to
    table = bounds.agg(F.array_sort(F.collect_list(F.struct("fold", "lo", "hi")))).scalar()
    role = lambda b: (F.when(t < b["lo"], "train")
                      .when((t >= b["lo"]) & (b["hi"].isNull() | (t < b["hi"])), "test"))
    rows = df.select("*", table.alias("_bounds"))
    mine = F.filter(F.transform("_bounds", lambda b: F.struct(b["fold"].alias("fold"), role(b).alias("role"))),
                    lambda r: r["role"].isNotNull())
    return rows.select(F.explode(mine).alias("_f"), *df.columns).select("_f.fold", "_f.role", *df.columns)


def except_split(df: DataFrame, train: DataFrame) -> DataFrame:
    """SET1: EXCEPT DISTINCT (``all - train``); note it drops duplicate rows."""
    return df.subtract(train)
