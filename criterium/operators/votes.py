"""Panel votes: what a verdict record counts as, consensus policies, completeness, agreement.

A vote table has one row per cell (``CELL`` columns) and judge, with ``judge``, ``judge_ord`` (place in the
panel), ``verdict`` and ``reason``. A judge without a row abstains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criterium.functions.stats import percent

CELL = ["prompt_id", "criterion_index", "model"]

# Reasons that mark a failure of the judge rather than of the answer.
ARTIFACTS = ["judge_refusal", "judge_parse_error", "judge_truncated", "missing_in_judge_output"]


def artifact_of(reason: Column) -> Column:
    """The artifact that a reason begins with, or null."""
    return F.coalesce(*(F.when(reason.startswith(a), a) for a in ARTIFACTS))


def vote_of(verdict: Column, reason: Column) -> Column:
    """PASS, FAIL or ABSTAIN."""
    return F.when(artifact_of(F.coalesce(reason, F.lit(""))).isNotNull(), "ABSTAIN").when(verdict == "PASS", "PASS").otherwise("FAIL")


def with_vote(votes: DataFrame) -> DataFrame:
    return votes.withColumn("vote", vote_of(F.col("verdict"), F.col("reason")))


def tally(votes: DataFrame, n_judges: int, anchor: str | None = None) -> DataFrame:
    """Per cell: n_pass, n_fail, n_abstain, the commonest failure reason, and the anchor's vote and reason.

    Failure reasons are counted in one aggregation: their sorted list and their places are gathered per
    cell, at most one entry a judge.
    """
    failed = F.when(F.col("vote") == "FAIL", F.struct(F.col("judge_ord").alias("ord"), F.coalesce("reason", F.lit("")).alias("reason")))
    own = F.col("judge") == F.lit(anchor)
    rows = with_vote(votes).groupBy(*CELL).agg(
        F.count_if(F.col("vote") == "PASS").alias("n_pass"),
        F.count_if(F.col("vote") == "FAIL").alias("n_fail"),
        F.array_sort(F.collect_list(failed)).alias("fails"),
        F.max(F.when(own & (F.col("vote") != "ABSTAIN"), F.struct("vote", F.coalesce("reason", F.lit("")).alias("reason")))).alias("anchor"),
    )
    count = lambda x: F.size(F.filter("fails", lambda y: y["reason"] == x["reason"]))
    ranked = F.transform("fails", lambda x: F.struct((-count(x)).alias("n"), x["ord"].alias("ord"), x["reason"].alias("reason")))
    return rows.withColumn("n_abstain", n_judges - F.col("n_pass") - F.col("n_fail")).withColumn("common", F.array_min(ranked)["reason"])


def _columns(*more: str) -> list:
    return [*CELL, "verdict", "reason", "n_pass", "n_fail", "n_abstain", *more]


def consensus_majority(votes: DataFrame, n_judges: int) -> DataFrame:
    """Majority with quorum min(2, judges); ties and cells below it fail."""
    low, tie, won = F.col("n_pass") + F.col("n_fail") < min(2, n_judges), F.col("n_pass") == F.col("n_fail"), F.col("n_pass") > F.col("n_fail")
    rows = tally(votes, n_judges)
    rows = rows.withColumn("verdict", F.when(~low & won, "PASS").otherwise("FAIL"))
    reason = F.when(low, "panel_no_quorum").when(tie, "panel_tie").when(won, "").otherwise(F.col("common"))
    return rows.withColumn("reason", reason).select(*_columns())


def failed_by_majority(votes: DataFrame, n_judges: int) -> DataFrame:
    """The cells that :func:`consensus_majority` fails for their votes, not for a tie or a low quorum: two counts a cell, no reasons are gathered."""
    rows = with_vote(votes).groupBy(*CELL).agg(F.count_if(F.col("vote") == "PASS").alias("n_pass"), F.count_if(F.col("vote") == "FAIL").alias("n_fail"))
    return rows.where((F.col("n_pass") + F.col("n_fail") >= min(2, n_judges)) & (F.col("n_fail") > F.col("n_pass")))


def consensus_anchored(votes: DataFrame, n_judges: int, anchor: str) -> DataFrame:
    """Majority with quorum 2; the anchor's vote breaks ties; what stays open is excluded."""
    low, tie, won = F.col("n_pass") + F.col("n_fail") < 2, F.col("n_pass") == F.col("n_fail"), F.col("n_pass") > F.col("n_fail")
    rows = tally(votes, n_judges, anchor)
    vote = F.col("anchor.vote")
    out = rows.withColumn(
        "verdict", F.when(low, "EXCLUDE").when(tie & vote.isNull(), "EXCLUDE").when(tie, vote).when(won, "PASS").otherwise("FAIL")
    )
    own = F.when(F.col("anchor.reason") == "", "panel_tiebreak_fail").otherwise(F.col("anchor.reason"))
    reason = (
        F.when(low, "panel_incomplete").when(tie & vote.isNull(), "panel_undecidable").when(tie & (vote == "PASS"), "").when(tie, own).when(won, "").otherwise(F.col("common"))
    )
    return out.withColumn("reason", reason).withColumn("tiebreak", ~low & tie & vote.isNotNull()).select(*_columns("tiebreak"))


def consensus(votes: DataFrame, n_judges: int, anchor: str | None = None) -> DataFrame:
    """The anchored policy where an anchor is named, else the majority."""
    return consensus_anchored(votes, n_judges, anchor) if anchor else consensus_majority(votes, n_judges)


def incomplete_cells(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Cells with under two valid votes, and the judges to ask again, in panel order."""
    rows = with_vote(votes).groupBy(*CELL).agg(
        F.count_if(F.col("vote") != "ABSTAIN").alias("n_valid"), F.collect_set(F.when(F.col("vote") != "ABSTAIN", F.col("judge"))).alias("voted")
    )
    return rows.where("n_valid < 2").select(*CELL, "n_valid", F.array_except(F.array(*map(F.lit, judges)), "voted").alias("abstaining"))


def completeness(votes: DataFrame, judges: list[str]) -> DataFrame:
    """One row: n_cells, n_incomplete, complete."""
    cells = with_vote(votes).groupBy(*CELL).agg(F.count_if(F.col("vote") != "ABSTAIN").alias("n_valid"))
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n_valid") < 2).alias("n_incomplete")).withColumn("complete", F.col("n_incomplete") == 0)


def wide(votes: DataFrame, judges: list[str]) -> DataFrame:
    """One row per cell with a column per judge: PASS, FAIL or null. One shuffle serves all agreement figures."""
    own = lambda j: F.when((F.col("judge") == j) & (F.col("vote") != "ABSTAIN"), F.col("vote"))
    return with_vote(votes).groupBy(*CELL).agg(*(F.max(own(j)).alias(j) for j in judges))


def pairwise_agreement(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Per ordered pair of judges: percent of the cells both voted on in which they agree (null without any)."""
    pairs = [(a, b) for a in judges for b in judges if a < b]
    table = wide(votes, judges)
    sums = table.agg(
        *(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n_{a}_{b}") for a, b in pairs), *(F.count_if(F.col(a) == F.col(b)).alias(f"k_{a}_{b}") for a, b in pairs)
    )
    both = [(x, y, a, b) for a, b in pairs for x, y in ((a, b), (b, a))]
    rows = F.array(*(F.struct(F.lit(x).alias("judge_a"), F.lit(y).alias("judge_b"), F.col(f"n_{a}_{b}").alias("n"), F.col(f"k_{a}_{b}").alias("agree")) for x, y, a, b in both))
    return sums.select(F.inline(rows)).select("judge_a", "judge_b", "n", percent(F.col("agree"), F.col("n"), None).alias("agreement"))


def abstentions(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Per judge, the cells without a valid vote."""
    sums = wide(votes, judges).agg(*(F.count_if(F.col(j).isNull()).alias(j) for j in judges))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(j).alias("judge"), F.col(j).alias("abstentions")) for j in judges))))


def fleiss_kappa(votes: DataFrame) -> DataFrame:
    """Fleiss' kappa over cells with at least two votes, any number of raters; null where chance agreement is 1."""
    cells = with_vote(votes).groupBy(*CELL).agg(F.count_if(F.col("vote") == "PASS").alias("p"), F.count_if(F.col("vote") == "FAIL").alias("f")).where("p + f >= 2")
    n = F.col("p") + F.col("f")
    each = (F.col("p") * (F.col("p") - 1) + F.col("f") * (F.col("f") - 1)) / (n * (n - 1))
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("p").alias("p"), F.sum("f").alias("f"), F.avg(each).alias("observed"))
    share = lambda x: F.pow(F.col(x) / (F.col("p") + F.col("f")), 2)
    chance = share("p") + share("f")
    return sums.select("cells", F.bround(F.when(chance < 1, (F.col("observed") - chance) / (1 - chance)), 4).alias("kappa"))


def agreement_with_consensus(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Per judge, percent agreement with the majority over decided cells; the majority policy whatever the panel's is."""
    table = wide(votes, judges)
    passes = reduce(lambda a, b: a + b, (F.coalesce((F.col(j) == "PASS").cast("int"), F.lit(0)) for j in judges))
    fails = reduce(lambda a, b: a + b, (F.coalesce((F.col(j) == "FAIL").cast("int"), F.lit(0)) for j in judges))
    decided = table.withColumn("p", passes).withColumn("f", fails).where((F.col("p") + F.col("f") >= min(2, len(judges))) & (F.col("p") != F.col("f")))
    decided = decided.withColumn("verdict", F.when(F.col("p") > F.col("f"), "PASS").otherwise("FAIL"))
    sums = decided.agg(*(F.count(j).alias(f"n_{j}") for j in judges), *(F.count_if(F.col(j) == F.col("verdict")).alias(f"k_{j}") for j in judges))
    rows = F.array(*(F.struct(F.lit(j).alias("judge"), F.col(f"n_{j}").alias("n"), F.col(f"k_{j}").alias("agree")) for j in judges))
    return sums.select(F.inline(rows)).select("judge", "n", percent(F.col("agree"), F.col("n"), None).alias("agreement"))


def artifact_counts(votes: DataFrame) -> DataFrame:
    """Artifacts per judge and kind."""
    return votes.select("judge", artifact_of(F.col("reason")).alias("artifact")).where("artifact is not null").groupBy("judge", "artifact").agg(F.count(F.lit(1)).alias("n"))


def concurrence(failures: DataFrame, votes: DataFrame) -> DataFrame:
    """Failure rows with their cell's vote split; cells without votes have zeros."""
    split = with_vote(votes).groupBy(*CELL).agg(*(F.count_if(F.col("vote") == v.upper()).alias(f"n_{v}") for v in ("pass", "fail", "abstain")))
    return failures.join(split, CELL, "left").na.fill(0, ["n_pass", "n_fail", "n_abstain"])


def all_concur_fail(row_type: Column, n_pass: Column, n_fail: Column) -> Column:
    """Two failing votes and no passing one; the older rows say ``both_fail`` as text."""
    return F.coalesce(row_type == "both_fail", F.lit(False)) | F.coalesce((n_fail >= 2) & (n_pass == 0), F.lit(False))
