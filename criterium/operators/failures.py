"""Causes of failures: rollups, shares, ranks, cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criterium.functions.stats import percent


def rollup(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Failures by cause, in total and within each dimension: one pass of grouping sets."""
    sets = [[F.col("root_cause")], *([F.col("root_cause"), F.col(d)] for d in dimensions)]
    grouped = rows.groupingSets(sets, F.col("root_cause"), *(F.col(d) for d in dimensions)).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(d).alias(f"_{d}") for d in dimensions))
    name = F.coalesce(*(F.when(F.col(f"_{d}") == 0, d) for d in dimensions), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")) for d in dimensions), F.lit(""))
    return grouped.select("root_cause", name.alias("dimension"), value.alias("value"), "n")


def shares(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per cause: n, percent of the total, running percent, rank (ties by name). One small row per cause in the window."""
    by = by or []
    n = rows.groupBy(*by, "root_cause").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(*by)
    order = every.orderBy(F.col("n").desc(), "root_cause")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    return n.select(
        *by, "root_cause", "n", percent(F.col("n"), F.sum("n").over(every)).alias("share"), percent(F.sum("n").over(up), F.sum("n").over(every)).alias("running"), F.row_number().over(order).alias("rank")
    )


def top_causes(rows: DataFrame, k: int) -> DataFrame:
    """One row: the k commonest causes, sorted by name."""
    return shares(rows).where(F.col("rank") <= k).agg(F.array_join(F.array_sort(F.collect_list("root_cause")), ",").alias("top"))


def same_top(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Whether two cuts have the same k commonest causes."""
    return top_causes(a, k).withColumnRenamed("top", "top_a").crossJoin(top_causes(b, k).withColumnRenamed("top", "top_b")).withColumn("holds", F.col("top_a") == F.col("top_b"))


def provenance(rows: DataFrame, version: str = "taxonomy_version") -> DataFrame:
    """The newest version, and all of them if mixed; a missing one is 1."""
    v = F.coalesce(F.col(version), F.lit(1))
    return rows.agg(F.max(v).cast("long").alias("version"), F.array_sort(F.collect_set(v)).alias("all")).select("version", F.when(F.size("all") > 1, F.array_join(F.col("all").cast("array<string>"), ",")).alias("mixed"))


def refusal_census(verdicts: DataFrame) -> DataFrame:
    """Cells with any refusal among their verdicts."""
    return verdicts.groupBy("prompt_id", "model").agg(F.count_if(F.col("reason").startswith("judge_refusal")).alias("n")).where("n > 0")


def concentration(rows: DataFrame, cause: str) -> DataFrame:
    """Cells of one cause by how often they have it."""
    return rows.where(F.col("root_cause") == cause).groupBy("prompt_id", "criterion_index").agg(F.count(F.lit(1)).alias("n"))


def confusion(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of labels."""
    return labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement_by(labels: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Agreement of two labels per group; rows without both are left out."""
    rows = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"))
    return rows.withColumn("agreement", percent(F.col("agree"), F.col("n"), None))


def failed_cells(consensus: DataFrame, done: DataFrame) -> DataFrame:
    """Cells that truly failed and have no diagnosis yet, with their failed criteria in order."""
    return without_diagnosis(consensus.where("verdict = 'FAIL' and reason not in ('panel_no_quorum', 'panel_tie')"), done)


def without_diagnosis(failed: DataFrame, done: DataFrame) -> DataFrame:
    """Failed criteria, a row each -> those of every cell that has no diagnosis yet, in order."""
    rows = failed.groupBy("model", "prompt_id").agg(F.array_sort(F.collect_list("criterion_index")).alias("failed"))
    return rows.join(done.select("model", "prompt_id").distinct(), ["model", "prompt_id"], "left_anti")


def predecessor(experiments: DataFrame, number: int) -> DataFrame:
    """The experiment with the largest number under ours that has a failure analysis."""
    return experiments.where((F.col("number") < number) & F.col("analysed")).orderBy(F.col("number").desc()).limit(1)
