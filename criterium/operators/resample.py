"""Cluster bootstraps over sufficient statistics.

A draw takes a cluster w times, w from a Poisson distribution of mean 1, which is what drawing as many clusters as
there are, with replacement, tends to. w comes from 32 of the 128 bits of ``md5(seed:block:key)``, so a cluster's
weights depend on nothing but its key and any engine repeats them; a hash serves a block of four draws. Every
cluster adds its statistics times w to all draws where it stands: one aggregation, whose shuffle has a row per
block of draws and task, whatever the number of clusters. No cluster is numbered, sorted or joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws that share a hash.
BLOCK = 4


def poisson_steps() -> list[int]:
    """At which of the 2**32 values of a hash a weight goes up by one."""
    steps, below = [], 0.0
    for k in range(20):
        below += math.exp(-1) / math.factorial(k)
        if math.floor(below * 2**32) >= 2**32 or steps and math.floor(below * 2**32) == steps[-1]:
            break
        steps.append(math.floor(below * 2**32))
    return steps


def weights(seed: Column | int, block: Column, key: Column) -> list[Column]:
    """The weights of a cluster in the draws of a block."""
    digest = F.md5(F.concat_ws(":", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), block.cast("string"), key.cast("string")))
    return [weight_of(F.substring(digest, 8 * k + 1, 8)) for k in range(BLOCK)]


def weight_of(bits: Column) -> Column:
    """The weight that eight hexadecimal digits stand for: they sort as their numbers, and most are under one of the first steps."""
    steps = [f"{s:08x}" for s in poisson_steps()]
    weight = F.when(bits < steps[0], 0)
    for k, s in enumerate(steps[1:], 1):
        weight = weight.when(bits < s, k)
    return weight.otherwise(len(steps))


def resampled_sums(clusters: DataFrame, key: Column | str, sums: list[str], n_boot: int, seed: Column | int, by: list[str] | None = None) -> DataFrame:
    """Per group and draw, the sums of the clusters' statistics; ``clusters`` has a row per group and cluster."""
    by, key = by or [], F.col(key) if isinstance(key, str) else key
    rows = clusters.select(*by, *sums, key.alias("_key"), (seed if isinstance(seed, Column) else F.lit(seed)).alias("_seed"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BLOCK))).alias("_block"))
    rows = rows.select(*by, *sums, "_block", F.array(*weights(F.col("_seed"), F.col("_block"), F.col("_key"))).alias("_w"))
    per_block = rows.groupBy(*by, "_block").agg(*(F.sum(F.col("_w")[k] * F.col(c)).alias(f"_{k}_{c}") for k in range(BLOCK) for c in sums))
    draws = F.array(*(F.struct((F.col("_block") * BLOCK + k).cast("long").alias("draw"), *(F.col(f"_{k}_{c}").alias(c) for c in sums)) for k in range(BLOCK)))
    return per_block.select(*by, F.inline(draws)).where(F.col("draw") < n_boot)


def cause_table(rows: DataFrame, causes: list[str], key: list[str] | None = None) -> DataFrame:
    """Per prompt, counts of every cause: the sufficient statistics of shares."""
    return rows.groupBy(*(key or ["prompt_id"])).agg(*(F.count_if(F.col("root_cause") == c).alias(c) for c in causes))


def shares_of(sums: DataFrame, causes: list[str], by: list[str]) -> DataFrame:
    """by, draw, root_cause, share; draws without any row are left out."""
    total = sum((F.col(c) for c in causes), F.lit(0))
    long = F.inline(F.array(*(F.struct(F.lit(c).alias("root_cause"), (F.col(c) / total).alias("share")) for c in causes)))
    return sums.where(total > 0).select(*by, "draw", long)


def share_samples(rows: DataFrame, causes: list[str], n_boot: int, seed: int) -> DataFrame:
    """draw, root_cause, share."""
    return shares_of(resampled_sums(cause_table(rows, causes), "prompt_id", causes, n_boot, seed), causes, [])


def interval(samples: DataFrame, by: list[str], value: str, interpolated: bool = False) -> DataFrame:
    """95 % limits: elements int(.025 n) and int(.975 n) of the sorted values, or interpolated percentiles."""
    if interpolated:
        return samples.groupBy(*by).agg(F.round(F.percentile(value, 0.025), 6).alias("lo"), F.round(F.percentile(value, 0.975), 6).alias("hi"))
    ordered = samples.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))  # n_boot numbers a group
    at = lambda q: F.get("v", F.least(F.floor(F.lit(q) * F.size("v")).cast("int"), F.size("v") - 1))
    return ordered.select(*by, F.round(at(0.025), 6).alias("lo"), F.round(at(0.975), 6).alias("hi"))


def share_intervals(rows: DataFrame, causes: list[str], n_boot: int, seed: int) -> DataFrame:
    return interval(share_samples(rows, causes, n_boot, seed), ["root_cause"], "share")


def difference_samples(left: DataFrame, right: DataFrame) -> DataFrame:
    """root_cause, difference of two tables of share samples; a cause that one of them lacks is 0 there."""
    both = left.join(right.withColumnRenamed("share", "other"), ["draw", "root_cause"], "full_outer")
    return both.select("root_cause", (F.coalesce("share", F.lit(0.0)) - F.coalesce("other", F.lit(0.0))).alias("difference"))


def share_difference(a: DataFrame, b: DataFrame, causes: list[str], n_boot: int, seed: int) -> DataFrame:
    """Intervals of the difference of shares; the two cuts are drawn independently, an absent cause is 0."""
    samples = difference_samples(share_samples(a, causes, n_boot, seed), share_samples(b, causes, n_boot, seed + 1))
    return interval(samples, ["root_cause"], "difference")


def statistic_interval(clusters: DataFrame, key: str, sums: list[str], statistic: Column, n_boot: int, seed: int) -> DataFrame:
    """Interpolated 95 % limits of any expression over resampled sums; draws in which it is null are left out."""
    samples = resampled_sums(clusters, key, sums, n_boot, seed).select(F.lit("all").alias("cut"), statistic.alias("statistic"))
    return interval(samples.where("statistic is not null"), ["cut"], "statistic", interpolated=True)


def recovery_intervals(counts: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """arm, cause, prompt_id, failed, recovered -> limits of the recovery rate per arm and cause.

    Every prompt is a cluster of every arm and cause, one stream of weights runs on over all of them, and a draw
    that takes no failed criterion counts as 0.
    """
    stream = F.concat_ws(":", "arm", "cause", F.col("prompt_id").cast("string"))
    sums = resampled_sums(counts, stream, ["failed", "recovered"], n_boot, seed, ["arm", "cause"])
    return interval(sums.select("arm", "cause", F.when(F.col("failed") > 0, F.col("recovered") / F.col("failed")).otherwise(0.0).alias("rate")), ["arm", "cause"], "rate")


def overlap_rule(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per cause, whether two intervals overlap; an absent one is (0, 0)."""
    left, right = a.select("root_cause", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")), b.select("root_cause", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    rows = left.join(right, "root_cause", "left").na.fill(0.0)
    return rows.select("root_cause", ((F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))).alias("overlap"))
