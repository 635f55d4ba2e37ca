"""Pass rates and counts over consensus rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criterium.functions.stats import fraction, percent


def scored(consensus: DataFrame) -> DataFrame:
    """Rows that count: exclusions are no part of any denominator."""
    return consensus.where("verdict <> 'EXCLUDE'").withColumn("passed", (F.col("verdict") == "PASS").cast("int"))


def pass_rate(consensus: DataFrame, by: list[str]) -> DataFrame:
    return scored(consensus).groupBy(*by).agg(F.sum("passed").alias("passed"), F.count(F.lit(1)).alias("scored")).withColumn("pass_rate", percent(F.col("passed"), F.col("scored")))


def per_prompt(consensus: DataFrame) -> DataFrame:
    """Per prompt and model: criteria passed as ``x/y``; a full pass needs a scored criterion and all of them passed."""
    rows = consensus.groupBy("prompt_id", "model").agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count_if(F.col("verdict") != "EXCLUDE").alias("scored"))
    full = (F.col("scored") > 0) & (F.col("passed") == F.col("scored"))
    return rows.withColumn("criteria_passed", fraction(F.col("passed"), F.col("scored"))).withColumn("full_pass", full)


def full_prompt_rate(consensus: DataFrame) -> DataFrame:
    """Per model, the percent of all its prompts that pass in full."""
    return per_prompt(consensus).groupBy("model").agg(F.count_if("full_pass").alias("full"), F.count(F.lit(1)).alias("prompts")).withColumn("rate", percent(F.col("full"), F.col("prompts")))


def breakdown(consensus: DataFrame, prompts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Pass rates by model, and by each dimension and model, in one pass of grouping sets.

    ``dimension`` names the grouping (``all`` for the model alone), ``value`` its value.
    """
    rows = scored(consensus).join(prompts.select("prompt_id", *dimensions), "prompt_id")
    sets = [[F.col("model")], *([F.col("model"), F.col(d)] for d in dimensions)]
    grouped = rows.groupingSets(sets, F.col("model"), *(F.col(d) for d in dimensions)).agg(
        F.sum("passed").alias("passed"), F.count(F.lit(1)).alias("scored"), *(F.grouping(d).alias(f"_{d}") for d in dimensions)
    )
    name = F.coalesce(*(F.when(F.col(f"_{d}") == 0, d) for d in dimensions), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dimensions), F.lit(""))
    return grouped.select("model", name.alias("dimension"), value.alias("value"), "passed", "scored", percent(F.col("passed"), F.col("scored")).alias("pass_rate"))


def exclusions(consensus: DataFrame) -> DataFrame:
    return consensus.where("verdict = 'EXCLUDE'").groupBy("model", "reason").agg(F.count(F.lit(1)).alias("n"))


def counts(votes: DataFrame) -> DataFrame:
    """One row of totals."""
    return votes.agg(
        F.countDistinct("prompt_id").alias("n_prompts"), F.countDistinct("prompt_id", "criterion_index").alias("n_criteria"),
        F.countDistinct("model").alias("n_models"), F.countDistinct("judge").alias("n_judges"), F.countDistinct("prompt_id", "model", "judge").alias("n_grade_cells"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column: column, value, n; one pass."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def eligible_prompts(prompts: DataFrame, tags: DataFrame, responses: DataFrame, grades: DataFrame, n_models: int, n_judges: int) -> DataFrame:
    """prompt_id with tags, every model's response and every judge's grade: eligible, and the reason if it is not."""
    has_tags = tags.select("prompt_id").distinct().withColumn("tagged", F.lit(True))
    answered = responses.groupBy("prompt_id").agg(F.countDistinct("model").alias("responses"))
    graded = grades.groupBy("prompt_id").agg(F.countDistinct("model", "judge").alias("grades"))
    rows = prompts.select("prompt_id").distinct().join(has_tags, "prompt_id", "left").join(answered, "prompt_id", "left").join(graded, "prompt_id", "left")
    reason = F.concat_ws(
        ",", F.when(F.col("tagged").isNull(), "tags"), F.when(F.coalesce("responses", F.lit(0)) < n_models, "responses"), F.when(F.coalesce("grades", F.lit(0)) < n_models * n_judges, "grades")
    )
    return rows.select("prompt_id", (reason == "").alias("eligible"), reason.alias("missing"))


def single_judge_view(criteria: DataFrame, models: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every criterion and model with one judge's verdict; a missing one fails."""
    rows = criteria.crossJoin(F.broadcast(models)).join(verdicts, ["prompt_id", "criterion_index", "model"], "left")  # models: the run's list
    return rows.withColumn("reason", F.when(F.col("verdict").isNull(), "missing_verdict").otherwise(F.col("reason"))).withColumn("verdict", F.coalesce("verdict", F.lit("FAIL")))
