"""Record-level steps around the panel: validation pools, guards, parsing, trainable rows, answers to multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criterium.functions.stats import percent
from criterium.functions.text import strip

# Artifacts that a validation sample leaves out. Missing rows stay in.
NOT_VALIDATED = ["judge_parse_error", "judge_truncated", "judge_refusal"]


def validation_pool(votes: DataFrame, prompts: DataFrame, responses: DataFrame, excerpt: int = 800) -> DataFrame:
    """Votes with an index within their prompt and no artifact, with the head of the answer."""
    bad = F.lit(False)
    for prefix in NOT_VALIDATED:
        bad = bad | F.coalesce(F.col("reason").startswith(prefix), F.lit(False))
    heads = responses.select("prompt_id", F.struct("model", F.left("response", F.lit(excerpt)).alias("head")).alias("one")).groupBy("prompt_id").agg(F.collect_list("one").alias("_heads"))
    # a prompt's heads, one a model, come with it: the votes, many times as many, are joined once
    asked = prompts.select("prompt_id", "n_criteria").join(heads, "prompt_id", "left")
    rows = votes.join(asked, "prompt_id").where(~bad & F.col("criterion_index").between(1, F.col("n_criteria")))
    own = F.transform(F.filter("_heads", lambda x: x["model"] == F.col("model")), lambda x: x["head"])
    return rows.withColumn("response_excerpt", F.explode_outer(own)).drop("_heads")


def human_filled(rows: DataFrame, human: str = "human") -> DataFrame:
    """Rows whose human verdict is PASS or FAIL, in upper case."""
    label = F.upper(strip(F.col(human)))
    return rows.withColumn(human, label).where(label.isin("PASS", "FAIL"))


def validation_status(rows: DataFrame, verdict: str, human: str) -> DataFrame:
    """One row: not_run without rows, sampled without human verdicts, else scored, with the agreement."""
    label = F.upper(strip(F.col(human)))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(label.isin("PASS", "FAIL")).alias("labelled"), F.count_if(label == F.col(verdict)).alias("agree"))
    status = F.when(F.col("n") == 0, "not_run").when(F.col("labelled") == 0, "sampled").otherwise("scored")
    return s.select(status.alias("status"), "n", "labelled", percent(F.col("agree"), F.col("labelled"), None).alias("agreement"))


def size_guard(rows: DataFrame, group: str, expected: dict[str, int]) -> DataFrame:
    """Counts per group against what was expected; groups of either side appear."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"`{group}` string, expected long")
    both = rows.groupBy(F.col(group)).agg(F.count(F.lit(1)).alias("n")).join(want, group, "full_outer").na.fill(0, ["n", "expected"])
    return both.withColumn("ok", F.col("n") == F.col("expected"))


def row_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in a alone, in b alone, in both."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, keys, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count("_a").alias("ours")).withColumn("same", F.col("missing") + F.col("extra") == 0)


def difficulty(rows: DataFrame, value: str) -> DataFrame:
    """Means by cause, and by cause and acceptance: one pass of grouping sets; accepted is null in the total."""
    sets = [[F.col("cause")], [F.col("cause"), F.col("accepted")]]
    return rows.groupingSets(sets, F.col("cause"), F.col("accepted")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def first_largest(values: Column) -> Column:
    """The place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def accuracy(rows: DataFrame, by: list[str], pred: str, gold: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(pred) == F.col(gold)).cast("int")), 6).alias("accuracy"))


def mean_score(rows: DataFrame, score: str) -> DataFrame:
    """The mean over all rows; rows without constraints score 0."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce(score, F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mean"))


def trainable(rows: DataFrame, kind: str, function: str) -> DataFrame:
    """Rows with a verifier and a conflict or aligned type, marked which."""
    found = F.when(F.col(kind).contains("conflict"), "conflict").when(F.col(kind).contains("aligned"), "aligned")
    return rows.withColumn("track", found).where(F.col("track").isNotNull() & F.col(function).isNotNull())


def within_length(rows: DataFrame, tokens: str, most: int) -> DataFrame:
    """One row: how many rows fit, and how many are too long."""
    return rows.agg(F.count_if(F.col(tokens) <= most).alias("kept"), F.count_if(F.col(tokens) > most).alias("too_long"))


def slug_parts(slug: Column) -> Column:
    """track, number and label of ``E08-some-label``."""
    part = lambda k: F.regexp_extract(slug, r"^([ET])(\d{2,})-(.+)$", k)
    return F.struct(F.nullif(part(1), F.lit("")).alias("track"), part(2).try_cast("int").alias("number"), F.nullif(part(3), F.lit("")).alias("label"))


def family_overlap(judges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Judges of the same family (before the slash) as a candidate."""
    family = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    theirs = candidates.select(family("model").alias("family")).distinct()
    return judges.withColumn("family", family("judge")).join(theirs, "family", "left_semi")


def numbers_of(text: Column) -> Column:
    """A number, or null for blanks and other text."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def completion_text(parts: Column) -> Column:
    """The contents of a message list, joined; null contents are empty."""
    return F.array_join(F.transform(parts, lambda m: F.coalesce(m["content"], F.lit(""))), "")


def yields(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Accepted share, attempts and tokens per group."""
    s = attempts.groupBy(*by).agg(F.count_if("accepted").alias("accepted"), F.sum("attempts").alias("attempts"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("yield", percent(F.col("accepted"), F.col("n")))


def source_stats(rows: DataFrame, cause: str, accepted: Column) -> DataFrame:
    """Per cause: rows, accepted ones, their share in percent, and ``target_n``, the least number of accepted ones of any cause. A row a cause in the window."""
    counts = rows.groupBy(cause).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"))
    return counts.select(cause, "n", "accepted", percent(F.col("accepted"), F.col("n"), digits=1).alias("yield_pct"), F.min("accepted").over(Window.partitionBy()).alias("target_n"))


def label_stats(rows: DataFrame, judge: str, human: str) -> DataFrame:
    """Labelled, open, agreeing and disagreeing rows."""
    done = F.col(human).isin("PASS", "FAIL")
    return rows.agg(
        F.count_if(done).alias("labelled"), F.count_if(F.coalesce(~done, F.lit(True))).alias("unlabelled"), F.count_if(done & (F.col(human) == F.col(judge))).alias("agree"), F.count_if(done & (F.col(human) != F.col(judge))).alias("disagree")
    )
