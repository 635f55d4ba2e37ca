"""Rates, windows and staleness over step and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criterium.operators.ranks import MIDDLE, elements_at, median_of
from criterium.operators.sampling import hashed_places, unused


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling", F.round(F.avg(value).over(w), 6))


def step_rates(df: DataFrame, keys: list[str], step: str, elapsed: Column) -> DataFrame:
    """Median and mean seconds a step between neighbours whose step grew."""
    w = Window.partitionBy(*keys).orderBy(step)
    rows = df.withColumn("_e", elapsed)
    rate = (F.col("_e") - F.lag("_e").over(w)) / (F.col(step) - F.lag(step).over(w))
    rows = rows.withColumn("rate", F.when(F.col(step) > F.lag(step).over(w), rate)).where("rate is not null")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("rate", 0.5), 3).alias("median_rate"), F.round(F.avg("rate"), 3).alias("mean_rate"))


def edge_means(df: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Means of the first and of the last k rows, and the first and last value."""
    up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))
    rows = df.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    at = lambda place, n: F.when(F.col(place) <= n, F.col(value))
    return rows.groupBy(*keys).agg(
        F.round(F.avg(at("_up", k)), 6).alias("first_mean"), F.round(F.avg(at("_down", k)), 6).alias("last_mean"), F.max(at("_up", 1)).alias("first_value"), F.max(at("_down", 1)).alias("last_value")
    )


def window_mean(df: DataFrame, keys: list[str], step: str, value: str, low: int, high: int) -> DataFrame:
    return df.where(F.col(step).between(low, high)).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"))


def centred(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Group-relative advantage; groups without variance are ``degenerate``."""
    w = Window.partitionBy(*group)
    spread = F.max(value).over(w) == F.min(value).over(w)
    return df.withColumn("advantage", F.round(F.col(value) - F.avg(value).over(w), 6)).withColumn("degenerate", spread)


def last_values(df: DataFrame, keys: list[str], metric: str, value: str, step: str) -> DataFrame:
    """The last value of each metric that is not null."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, metric).agg(F.max_by(value, step).alias("last"))


def stale(df: DataFrame, keys: list[str], order: str, counter: str, limit: float) -> DataFrame:
    """Per key, seconds from the last change of the counter to the last row, and whether they exceed the limit."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.lag(counter).over(w).isNull() | ~F.col(counter).eqNullSafe(F.lag(counter).over(w))
    rows = df.withColumn("_moved", F.when(changed, F.col(order))).groupBy(*keys).agg(F.max("_moved").alias("moved"), F.max(order).alias("seen"))
    idle = (F.unix_micros(F.col("seen").cast("timestamp")) - F.unix_micros(F.col("moved").cast("timestamp"))) / 1e6
    return rows.select(*keys, F.round(idle, 3).alias("idle"), (idle > limit).alias("stale"))


def eta(stages: DataFrame, fallback: float) -> DataFrame:
    """stages (stage, done, total, rate: seconds an item) -> seconds left in all; ``fallback`` where no rate is known."""
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return stages.agg(F.round(F.sum(left * F.coalesce("rate", F.lit(fallback))), 6).alias("eta_s"), F.sum("done").alias("done"), F.sum("total").alias("total"))


def health_flags(rows: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """Names of the limits that a row breaks, in order."""
    return rows.withColumn("flags", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in limits.items()))), ","))


def throughput(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.round(F.expr("try_divide(sum(tokens), sum(seconds))"), 6).alias("tokens_per_s"))


def ring_batches(pool: DataFrame, key: str, size: int, rounds: int, start: int, seed: int) -> DataFrame:
    """step, slot, key: batches of ``size`` that run round the pool in hashed order, from place ``start``, until each has come ``rounds`` times.

    A row's batches follow from its place alone, so nothing but the pool's places is computed in order.
    """
    one, place, total = unused(pool, "_one"), unused(pool, "_place"), unused(pool, "_total")
    rows = hashed_places(pool.select(key, F.lit(1).alias(one)), [one], [key], seed, place, total)
    at = F.pmod(F.col(place) - 1 - F.lit(start), F.col(total)) + F.col("lap") * F.col(total)
    rows = rows.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("at", at)
    return rows.select(F.floor(F.col("at") / size).alias("step"), (F.col("at") % size).alias("slot"), key)


def length_stats(df: DataFrame, keys: list[str], tokens: str, limit: int) -> DataFrame:
    """n, least, median, 95th (element int(.95 n)), most, and the share over the limit."""
    rows = df.groupBy(*keys).agg(F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.round(F.avg((F.col(tokens) > limit).cast("int")), 6).alias("over_rate"))
    last = lambda n: F.least(F.floor(0.95 * n), n - 1)
    found = elements_at(df, keys, tokens, {**MIDDLE, "p95": (0.95, last)}).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "n", median_of("_low", "_high").alias("median"), "p95")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return rows.join(found, match).select(*keys, "n", "least", "median", "most", "over_rate", "p95")
