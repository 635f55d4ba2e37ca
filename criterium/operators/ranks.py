"""Exact order statistics that no single task has to sort: agreement of two rankings, elements at given ranks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds that cut either ranking into intervals.
PARTS = 256


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Over all pairs of rows with different x, the sum of w * w * sign of (x - x') (y - y'): halves are merged, level by level."""
    if len(x) < 2:
        return 0
    order = np.lexsort((y, x))
    x, y, w = x[order], np.unique(y, return_inverse=True)[1].reshape(-1)[order], w[order].astype(np.int64)
    at, size, total = np.arange(len(x)), 1, 0
    while size < len(x):
        block = at // (2 * size)
        o = np.lexsort((y, block))
        left = (at // size % 2 == 0)[o]
        b, v, own = block[o], y[o], w[o]
        below = np.cumsum(np.where(left, own, 0))
        starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (v[1:] != v[:-1])])
        ends = np.r_[starts[1:], len(o)] - 1
        each = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(o)]))
        first = np.searchsorted(b, b, side="left")
        last = np.searchsorted(b, b, side="right") - 1
        base = np.where(first > 0, below[first - 1], 0)
        less = np.where(starts > 0, below[starts - 1], 0)[each] - base
        more = below[last] - below[ends][each]
        total += int((own * (less - more))[~left].sum())
        size *= 2
    # rows of one x came in order of y, so all their pairs with different y counted as agreeing
    same_x = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    same_xy = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return total - int((np.add.reduceat(w, same_x) ** 2).sum() - (np.add.reduceat(w, same_xy) ** 2).sum()) // 2


def _intervals(df: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """``_p_`` of each column: 2 k for the k-th bound itself, 2 k + 1 for what lies between it and the next. The bounds are quantiles."""
    from pyspark.ml.feature import Bucketizer

    at = [k / parts for k in range(1, parts)]
    found = df.agg(*(F.percentile_approx(c, at, 20 * parts).alias(c) for c in columns)).first()  # a few hundred numbers
    for c in columns:
        bounds = sorted(set(found[c] or [0.0]))
        df = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol=c, outputCol=f"_k_{c}").transform(df)
        own = F.get(F.array(*map(F.lit, bounds)), F.col(f"_k_{c}").cast("int") - 1)
        df = df.withColumn(f"_p_{c}", (2 * F.col(f"_k_{c}") + F.when(F.coalesce(own == F.col(c), F.lit(False)), 0).otherwise(1)).cast("int")).drop(f"_k_{c}")
    return df


def kendall_tau(ranks: DataFrame, a: str, b: str, parts: int = PARTS) -> DataFrame:
    """Kendall's tau-a of two numeric rankings of the same items (one row an item): pairs, tau; null under two items with both.

    Equal (a, b) are counted first. Quantiles cut either ranking into intervals and the bounds themselves, within which all
    are equal. A pair of rows stands in two intervals of both rankings (a matrix of counts tells these), in one of the first,
    or in one of the second but not of the first; every interval is a group of some rows / ``parts`` of different values.
    """
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = ranks.select(real(a).alias("a"), real(b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    rows = _intervals(rows, ["a", "b"], parts)

    def counted(x: str, y: str) -> Callable:
        def run(frame):
            import pandas as pd

            return pd.DataFrame({"s": [concordance(frame[x].to_numpy(), frame[y].to_numpy(), frame["w"].to_numpy())]})

        return run

    cells = rows.groupBy("_p_a", "_p_b").agg(F.sum("w").alias("w")).groupBy().applyInPandas(counted("_p_a", "_p_b"), "s long")  # at most (2 parts)**2 rows
    first = rows.where("_p_a % 2 = 1").select("_p_a", "a", "b", "w").groupBy("_p_a").applyInPandas(counted("a", "b"), "s long")
    second = rows.where("_p_b % 2 = 1").groupBy("_p_b", "_p_a", "b").agg(F.sum("w").alias("w")).groupBy("_p_b").applyInPandas(counted("_p_a", "b"), "s long")
    n = rows.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
    total = cells.unionByName(first).unionByName(second).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    return n.crossJoin(total).select(F.expr("n * (n - 1) div 2").alias("pairs"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))  # one row each


#: Of percentile_approx: its ranks are off by 1 / ACCURACY of the rows at most.
ACCURACY = 10_000


def elements_at(df: DataFrame, keys: list[str], value: str, at: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int = ACCURACY) -> DataFrame:
    """keys, n and, by name, the element at a 0-based rank of the key's sorted values: a share of the rows near the rank, and the rank as a function of n.

    Mergeable summaries, one a key, bracket every rank; then the rows below a bracket are counted and those in it are counted
    by value, both before the shuffle. What is sorted for a key are the different values in its brackets, some 4 / ``accuracy``
    of its rows. Null values count for nothing; keys without values are left out; null keys are a key.
    """
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    near = [min(1.0, max(0.0, q + s * 2 / accuracy)) for q, _ in at.values() for s in (-1, 1)]
    brackets = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count(value).alias("_n"), F.percentile_approx(value, near, accuracy).alias("_b"))
    # a rank may lie one row or two beside its share, so brackets reach to the ends where there are few rows
    targets = [
        F.struct(F.lit(t).alias("t"), rank(F.col("_n")).cast("long").alias("rank"), F.when(F.col("_n") > accuracy, F.col("_b")[2 * t]).alias("lo"), F.when(F.col("_n") > accuracy, F.col("_b")[2 * t + 1]).alias("hi"))
        for t, (_, rank) in enumerate(at.values())
    ]
    brackets = brackets.select("*", F.array(*targets).alias("_t"))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).join(brackets, match).select(*names, "_n", F.col(value).alias("_v"), F.explode("_t").alias("_t"))
    rows = rows.where(F.col("_t.hi").isNull() | (F.col("_v") <= F.col("_t.hi")))
    inside = F.when(F.col("_t.lo").isNull() | (F.col("_v") >= F.col("_t.lo")), F.col("_v"))
    counts = rows.groupBy(*names, "_n", F.col("_t.t").alias("_i"), F.col("_t.rank").alias("_rank"), inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*names, "_i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
    found = [F.max(F.when(F.col("_i") == t, F.col("_v"))).alias(name) for t, name in enumerate(at)]
    return hit.groupBy(*names).agg(F.max("_n").alias("n"), *found).select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "n", *at)


def median_of(low: str, high: str) -> Column:
    return (F.col(low).cast("double") + F.col(high).cast("double")) / 2


MIDDLE = {"_low": (0.5, lambda n: F.floor((n - 1) / 2)), "_high": (0.5, lambda n: F.floor(n / 2))}
