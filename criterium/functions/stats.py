"""Column functions for rates, intervals and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def percent(k: Column, n: Column, empty: float | None = 0.0, digits: int = 2) -> Column:
    """100 k / n, rounded half to even; ``empty`` where n is 0."""
    return F.when(n > 0, F.bround(100.0 * k / n, digits)).otherwise(F.lit(empty).cast("double"))


def fraction(k: Column, n: Column) -> Column:
    return F.concat_ws("/", k.cast("string"), n.cast("string"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval, (0, 1) for n = 0."""
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def percentile_index(values: Column, q: float, last: bool = False) -> Column:
    """The element at int(q n) of the sorted values (``last``: n - 1 at most)."""
    ordered = F.array_sort(values)
    at = F.floor(F.lit(q) * F.size(ordered)).cast("int")
    return F.get(ordered, F.least(at, F.size(ordered) - 1) if last else at)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two 0/1 raters: n, agreement in percent, kappa (null if chance agreement is 1)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.where(x.isNotNull() & y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb")
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("n", F.bround(100 * F.col("po"), 2).alias("agreement"), F.bround(F.when(chance < 1, (F.col("po") - chance) / (1 - chance)), 4).alias("kappa"))


def share_of_total(n: Column) -> Column:
    return n / F.sum(n).over(Window.partitionBy())


def linear_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The least-squares slope of y against x, 0 for under two points or constant x."""
    return df.groupBy(*keys).agg(F.coalesce(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.lit(0.0)).alias("slope"))
