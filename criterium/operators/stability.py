"""Whether the ranking of failure causes of one run holds in a later one: four cuts, their intervals, a decision.

The cuts are the earlier run, the later one, and the later one's rows on prompts that the earlier run has, or has
not. Failure rows are read once: counts per run and prompt (:func:`clusters`) are all that the rest needs, and one
aggregation draws all cuts (:func:`drawn`). What follows has a row per cut, cause and draw at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criterium.functions.stats import wilson
from criterium.operators import resample

EARLIER, LATER, SHARED, DISJOINT = "earlier", "later", "later_shared", "later_disjoint"


def clusters(rows: DataFrame, run: str, earlier, later, causes: list[str]) -> DataFrame:
    """cut, prompt_id and counts of every cause; a later prompt stands in two cuts. One shuffle by prompt."""
    side = F.when(F.col(run) == F.lit(earlier), EARLIER).when(F.col(run) == F.lit(later), LATER)
    sided = rows.withColumn("_side", side).where(F.col("_side").isNotNull() & F.col("root_cause").isin(*causes))
    of = lambda s, c: F.count_if((F.col("_side") == s) & (F.col("root_cause") == c))
    wide = sided.groupBy("prompt_id").agg(*(of(s, c).alias(f"_{s}_{c}") for s in (EARLIER, LATER) for c in causes))
    held = lambda s: sum((F.col(f"_{s}_{c}") for c in causes), F.lit(0)) > 0
    row = lambda cut, s: F.struct(cut.alias("cut"), *(F.col(f"_{s}_{c}").alias(c) for c in causes))
    own = F.when(held(EARLIER), SHARED).otherwise(DISJOINT)
    every = F.array(F.when(held(EARLIER), row(F.lit(EARLIER), EARLIER)), F.when(held(LATER), row(F.lit(LATER), LATER)), F.when(held(LATER), row(own, LATER)))
    return wide.select("prompt_id", F.inline(F.array_compact(every)))


def ranking(cuts: DataFrame, causes: list[str]) -> DataFrame:
    """cut, root_cause, n, rank (commonest first, ties by name), share, n_rows, n_prompts, wilson_lo, wilson_hi; causes without rows are left out."""
    sums = cuts.groupBy("cut").agg(F.count(F.lit(1)).alias("n_prompts"), *(F.sum(c).alias(c) for c in causes))
    total = sum((F.col(c) for c in causes), F.lit(0))
    long = F.inline(F.array(*(F.struct(F.lit(c).alias("root_cause"), F.col(c).alias("n")) for c in causes)))
    rows = sums.select("cut", "n_prompts", total.alias("n_rows"), long).where("n > 0")
    lo, hi = wilson(F.col("n"), F.col("n_rows"))
    place = F.row_number().over(Window.partitionBy("cut").orderBy(F.desc("n"), "root_cause"))  # a row a cause
    return rows.select("cut", "root_cause", "n", place.alias("rank"), F.round(F.col("n") / F.col("n_rows"), 6).alias("share"), "n_rows", "n_prompts", F.round(lo, 6).alias("wilson_lo"), F.round(hi, 6).alias("wilson_hi"))


def drawn(cuts: DataFrame, causes: list[str], n_boot: int, seed: int) -> DataFrame:
    """cut, draw, root_cause, share of all cuts, and of the earlier run once more, drawn with ``seed + 1``, as cut ``again``."""
    again = F.when(F.col("cut") == EARLIER, F.array(F.struct(F.col("cut").alias("cut"), F.lit(seed).alias("_s")), F.struct(F.lit("again").alias("cut"), F.lit(seed + 1).alias("_s"))))
    rows = cuts.select("prompt_id", *causes, F.inline(F.coalesce(again, F.array(F.struct(F.col("cut").alias("cut"), F.lit(seed).alias("_s"))))))
    return resample.shares_of(resample.resampled_sums(rows, "prompt_id", causes, n_boot, F.col("_s"), ["cut"]), causes, ["cut"])


def cut_table(cuts: DataFrame, causes: list[str], n_boot: int, seed: int) -> DataFrame:
    """:func:`ranking` with the bootstrap's limits ``lo`` and ``hi``."""
    limits = resample.interval(drawn(cuts, causes, n_boot, seed), ["cut", "root_cause"], "share")
    return ranking(cuts, causes).join(limits, ["cut", "root_cause"])


def deltas(cuts: DataFrame, causes: list[str], n_boot: int, seed: int) -> DataFrame:
    """Limits of the later run's share minus the earlier one's, drawn independently; a cause that neither has is left out."""
    samples = drawn(cuts.where(F.col("cut").isin(EARLIER, LATER)), causes, n_boot, seed)
    later, earlier = (samples.where(F.col("cut") == c).drop("cut") for c in (LATER, "again"))
    known = ranking(cuts.where(F.col("cut").isin(EARLIER, LATER)), causes).select("root_cause").distinct()
    return resample.interval(resample.difference_samples(later, earlier).join(known, "root_cause", "left_semi"), ["root_cause"], "difference")


def rank_agreement(ranked: DataFrame) -> DataFrame:
    """cut, n_common, tau: Kendall's tau-a of each later cut's ranking against the earlier run's, over the causes that both have; null under two.

    Rankings of causes have a row a cause, so all pairs of them are few.
    """
    earlier = F.broadcast(ranked.where(F.col("cut") == EARLIER).select("root_cause", F.col("rank").alias("before")))
    both = ranked.where(F.col("cut") != EARLIER).join(earlier, "root_cause").groupBy("cut").agg(F.array_sort(F.collect_list(F.struct("rank", "before"))).alias("r"))
    after = lambda i: F.slice("r", i + 2, F.size("r"))
    signs = F.flatten(F.transform("r", lambda x, i: F.transform(after(i), lambda y: F.signum(y["before"].cast("double") - x["before"]))))
    n = F.size("r")
    return both.select("cut", n.cast("long").alias("n_common"), F.when(n > 1, F.round(F.aggregate(signs, F.lit(0.0), lambda s, x: s + x) / (n * (n - 1) / 2), 6)).alias("tau"))


def decision(table: DataFrame, k: int = 3) -> DataFrame:
    """One row of :func:`cut_table`'s: both runs' ``k`` commonest causes by name, whether they are the same, how many
    of the earlier run's have intervals that overlap, and ``confirmed``: the same set, and all overlap."""
    limits = table.where(F.col("cut").isin(EARLIER, LATER))
    of = lambda s: F.array_sort(F.collect_list(F.when((F.col("cut") == s) & (F.col("rank") <= k), F.col("root_cause"))))
    at = lambda s, c: F.coalesce(F.max(F.when(F.col("cut") == s, F.col(c))), F.lit(0.0))
    each = limits.groupBy("root_cause").agg(
        F.max(F.when(F.col("cut") == EARLIER, F.col("rank"))).alias("_rank"), ((at(LATER, "lo") <= at(EARLIER, "hi")) & (at(EARLIER, "lo") <= at(LATER, "hi"))).alias("_overlap")
    ).agg(F.count_if(F.col("_overlap") & (F.col("_rank") <= k)).alias("n_overlap"))
    tops = limits.agg(of(EARLIER).alias("a"), of(LATER).alias("b")).crossJoin(each)  # one row each
    same = F.col("a") == F.col("b")
    return tops.select(
        F.array_join("a", ",").alias("earlier_top"), F.array_join("b", ",").alias("later_top"), same.alias("set_holds"), "n_overlap",
        (same & (F.col("n_overlap") == F.size("a"))).alias("confirmed"),
    )


def proxies(rows: DataFrame, restrictions: dict[str, str], k: int = 3) -> DataFrame:
    """proxy, n_rows, top, matches: each restriction's ``k`` commonest causes, and whether they are those of all rows.

    ``restrictions`` maps a name to a condition in SQL; rows of which it is null are left out. One pass over the rows.
    """
    of = {"full": F.lit(True), **{name: F.coalesce(F.expr(c), F.lit(False)) for name, c in restrictions.items()}}
    counts = rows.groupBy("root_cause").agg(*(F.count_if(c).alias(name) for name, c in of.items()))
    long = counts.select("root_cause", F.inline(F.array(*(F.struct(F.lit(name).alias("proxy"), F.col(name).alias("n")) for name in of)))).where("n > 0")
    place = F.row_number().over(Window.partitionBy("proxy").orderBy(F.desc("n"), "root_cause"))  # a row a cause
    tops = long.withColumn("_place", place).groupBy("proxy").agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_place") <= k, F.col("root_cause")))), ",").alias("top"))
    full = F.max(F.when(F.col("proxy") == "full", F.col("top"))).over(Window.partitionBy())  # a row a restriction
    return tops.select("proxy", "n_rows", "top", (F.col("top") == full).alias("matches"))
