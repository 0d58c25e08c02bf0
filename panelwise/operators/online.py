"""Learning on batches (ML23): logistic regression warm-started from saved coefficients.

The state is a small table: per feature its scaling (mean and deviation of the first batch, kept from
then on) and its coefficient, and one row for the intercept.  A batch moves the coefficients by
one gradient step, and its gradient is one aggregation over the batch: sums of (p - y) x, which
Spark combines before the shuffle.  Only these few numbers (one a feature) reach the driver.
Batches can be learned today and tomorrow: the state is written and read between them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERCEPT = "(intercept)"
_SCHEMA = "step int, name string, mean double, deviation double, coefficient double"


@dataclass(frozen=True)
class Online:
    """Coefficients over scaled features after ``step`` batches."""

    features: tuple[str, ...]
    step: int = 0
    mean: tuple[float, ...] = ()
    deviation: tuple[float, ...] = ()
    coefficients: tuple[float, ...] = ()
    intercept: float = 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        """The state as a table, one row a feature and one for the intercept."""
        k = len(self.features)
        rows = list(zip([self.step] * k, self.features, self.mean or [None] * k, self.deviation or [None] * k, self.coefficients or [0.0] * k))
        return spark.createDataFrame([*rows, (self.step, INTERCEPT, None, None, self.intercept)], _SCHEMA)

    def scaled(self) -> list[Column]:
        return [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.mean, self.deviation)]

    def probability(self) -> Column:
        """Probability of class 1 as one expression."""
        z = F.lit(self.intercept)
        for x, w in zip(self.scaled(), self.coefficients):
            z = z + F.lit(w) * x
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def save(state: Online, spark: SparkSession, path: str) -> None:
    state.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Online:
    rows = {r["name"]: r for r in spark.read.schema(_SCHEMA).parquet(path).collect()}  # one row a feature
    last = rows.pop(INTERCEPT)
    names = tuple(sorted(rows))
    fitted = all(rows[n]["mean"] is not None for n in names)
    return Online(names, last["step"], *(tuple(rows[n][c] for n in names) if fitted else () for c in ("mean", "deviation", "coefficient")),
                  last["coefficient"])


def learn(batch: DataFrame, state: Online, label: str = "failure", rate: float = 1.0, l2: float = 0.0) -> Online:
    """One gradient step of the mean log loss on the batch, of size ``rate / sqrt(step)``.

    Rows with a null or NaN feature or no label are left out; a batch without rows changes nothing.
    A feature that is constant in the first batch is only centred."""
    state = replace(state, features=tuple(sorted(state.features)))
    rows = batch.filter(F.col(label).isNotNull())
    for c in state.features:
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    k = len(state.features)
    if not state.mean:
        m = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(state.features)],
                     *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(state.features)]).first()
        if m["m0"] is None:
            return state
        state = replace(state, mean=tuple(m[f"m{i}"] for i in range(k)), deviation=tuple(m[f"s{i}"] or 1.0 for i in range(k)),
                        coefficients=state.coefficients or (0.0,) * k)
    error = state.probability() - F.col(label).cast("double")
    g = rows.select(error.alias("e"), *[x.alias(f"x{i}") for i, x in enumerate(state.scaled())]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("g"), *[F.sum(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)]).first()
    if not g["n"]:
        return state
    size = rate / (state.step + 1) ** 0.5
    moved = tuple(w - size * (g[f"g{i}"] / g["n"] + l2 * w) for i, w in enumerate(state.coefficients))
    return replace(state, step=state.step + 1, coefficients=moved, intercept=state.intercept - size * g["g"] / g["n"])
