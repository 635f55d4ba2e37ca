"""Majorities over repeated decodes, recovery and breakage against the base arm, and their contrasts.

Criterion records have ``arm``, ``cause``, ``prompt_id``, ``criterion_id``, ``passed`` (boolean), one row per decode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITERION = ["cause", "prompt_id", "criterion_id"]


def majority(records: DataFrame, arms: list[str] | None = None) -> DataFrame:
    """Strict majority of the decodes.

    The arms that are named are columns of one aggregation, with a row a criterion in its shuffle; all others have a row an arm there.
    """
    rest = records if arms is None else records.where(~F.coalesce(F.col("arm").isin(arms), F.lit(False)))
    own = rest.groupBy("arm", *CRITERION).agg((2 * F.count_if("passed") > F.count(F.lit(1))).alias("passed"))
    if arms is None:
        return own
    rows = records.where(F.col("arm").isin(arms)).groupBy(*CRITERION).agg(*(_majority_of(a).alias(f"arm_{k}") for k, a in enumerate(arms)))
    long = F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"arm_{k}").alias("passed")) for k, a in enumerate(arms))))
    return rows.select(*CRITERION, long).where("passed is not null").select("arm", *CRITERION, "passed").unionByName(own)


def _majority_of(arm: str) -> Column:
    """Of the decodes of one arm in a group; null without any. Both counts are one sum: decodes that pass count 1, others -1."""
    one = F.when(F.col("arm") == arm, F.when(F.coalesce("passed", F.lit(False)), 1).otherwise(-1))
    return F.sum(one) > 0


def recovery(votes: DataFrame, arms: list[str], base: str = "0", by: list[str] | None = None) -> DataFrame:
    """Per arm and group: what the base arm failed and this arm recovered, what it passed and this arm broke.

    An arm without a row recovers nothing and breaks nothing. The arms are columns of one hash aggregation, not a self-join.
    """
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("passed")))
    return _against(votes.groupBy(*CRITERION).agg(of(base).alias("base"), *(of(a).alias(f"arm_{k}") for k, a in enumerate(arms))), arms, by)


def recovery_of_records(records: DataFrame, arms: list[str], base: str = "0", by: list[str] | None = None) -> DataFrame:
    """:func:`recovery` of the records' :func:`majority`, both in one aggregation: decodes and passes of every arm are counted per criterion."""
    rows = records.where(F.col("arm").isin(base, *arms)).groupBy(*CRITERION)
    return _against(rows.agg(_majority_of(base).alias("base"), *(_majority_of(a).alias(f"arm_{i}") for i, a in enumerate(arms))), arms, by)


def _against(rows: DataFrame, arms: list[str], by: list[str] | None) -> DataFrame:
    """Criteria with ``base`` and a column an arm -> counts per arm and group."""
    by = by or ["cause"]
    rows = rows.where("base is not null").select(*by, "base", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"arm_{k}").alias("own")) for k, a in enumerate(arms)))))
    return rows.groupBy("arm", *by).agg(
        F.count_if(~F.col("base")).alias("failed"), F.count_if(~F.col("base") & F.coalesce("own", F.lit(False))).alias("recovered"),
        F.count_if("base").alias("held"), F.count_if(F.col("base") & (F.col("own") == F.lit(False))).alias("broken"),
    )


def decode_rates(records: DataFrame) -> DataFrame:
    """The share of single decodes that pass, per arm and cause."""
    return records.groupBy("arm", "cause").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("rate"))


def false_recovery(spot_checks: DataFrame, false: Column, by: str = "cause") -> DataFrame:
    """Per group, recoveries that were looked at, and the share that was none."""
    return spot_checks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(false).alias("false"), F.round(F.avg(false.cast("int")), 6).alias("rate"))


def rates(counts: DataFrame) -> DataFrame:
    """Recovery, breakage and the net of :func:`recovery`; null without a denominator."""
    return (
        counts.withColumn("rec", F.round(F.expr("try_divide(recovered, failed)"), 6))
        .withColumn("brk", F.round(F.expr("try_divide(broken, held)"), 6))
        .withColumn("net", F.col("recovered") - F.col("broken"))
    )


def contrast(rec: DataFrame, terms: list[tuple[float, str, str]], keys: list[str] | None = None, name: str = "contrast") -> DataFrame:
    """Sum of weight x recovery rate over (weight, arm, cause), per key."""
    weight = F.coalesce(*(F.when((F.col("arm") == a) & (F.col("cause") == c), F.lit(float(w))) for w, a, c in terms))
    rows = rec.withColumn("w", weight).where("w is not null")
    total = F.sum(F.col("w") * F.expr("try_divide(recovered, failed)"))
    whole = F.count_if(F.col("failed") > 0) == len(terms)
    return rows.groupBy(*(keys or [])).agg(F.when(whole, total).alias(name))


# The contrasts of the 2 x 2 design.
INTERACTION = [(1, "RB", "precision"), (-1, "SB", "precision"), (-1, "RA", "coverage"), (1, "SA", "coverage")]
TARGETING = [(1, "SA", "coverage"), (-1, "SB", "coverage"), (-1, "SA", "precision"), (1, "SB", "precision")]


def treated(records: DataFrame, variant: str) -> DataFrame:
    """Sensitivity treatments of capped decodes: V0 none, V1 left out, V2 prompts with any left out, V3 counted as passed."""
    if variant == "V0":
        return records
    if variant == "V1":
        return records.where("not capped")
    if variant == "V2":
        hit = records.where("capped").select("prompt_id").distinct()
        return records.join(hit, "prompt_id", "left_anti")
    if variant == "V3":
        return records.withColumn("passed", F.col("passed") | F.col("capped"))
    raise ValueError(f"unknown variant {variant}")


def kind_rates(records: DataFrame, kind: Column) -> DataFrame:
    """Failure rates by kind of criterion, for capped and uncapped decodes, and the capped share of failures."""
    fail = (~F.col("passed")).cast("int")
    rows = records.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("capped"), fail)), 6).alias("capped_fail_rate"),
        F.round(F.avg(F.when(~F.col("capped"), fail)), 6).alias("uncapped_fail_rate"), F.count_if(~F.col("passed")).alias("failures"), F.count_if(~F.col("passed") & F.col("capped")).alias("capped_failures"),
    )
    return rows.withColumn("capped_share", F.round(F.expr("try_divide(capped_failures, failures)"), 6))


def artifact_tell(meta: DataFrame) -> DataFrame:
    """Means per arm and cause that show an artifact: lengths, and rates of marker, malformed and capped decodes."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate")
    return meta.groupBy("arm", "cause").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("answer_chars"), 6).alias("mean_chars"), rate("marker"), rate("malformed"), rate("capped"))


def delta_guard(accuracy: DataFrame, base: str = "0", limit: float = -3.0) -> DataFrame:
    """Per arm, accuracy less the base arm's in percentage points, and whether it falls under the limit."""
    own = accuracy.where(F.col("arm") == base).select(F.col("accuracy").alias("base_accuracy"))
    rows = accuracy.crossJoin(F.broadcast(own))  # one row
    return rows.withColumn("delta_pp", F.round(100 * (F.col("accuracy") - F.col("base_accuracy")), 6)).withColumn("fails", (F.col("arm") != base) & (F.col("delta_pp") < limit))
