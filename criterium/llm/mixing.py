"""Mix sources to target weights by systematic sampling.

A source's target is its share of ``budget`` x all sizes by weight, stopped at ``cap`` times its
size with the excess shared again by weight (water filling). Every document of a source expects
target / source size copies; the documents stand in order of size and a hash, the expected copies
are summed up, one offset per source is added, and a document is emitted once per integer boundary
that its interval crosses. Ordering by size makes the words taken follow the target closely.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, in
the last place; sources of size 0 have target 0; an empty table gives no rows; repeated rows are
documents of their own; other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criterium.llm.common import ranked, same, settled, small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], budget: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size, one row per source) -> and its target.

    The level is the one at which the targets min(cap x size, level x weight) sum up to the
    budget: sources enter in order of cap / weight, and those below the level are at their cap.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1))
    rows = rows.withColumn("limit", cap * F.col("source_size"))
    up = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("full", F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (budget * F.sum("source_size").over(every) - F.coalesce("full", F.lit(0.0))) / F.col("open"))
    # the first source whose cap is above the level reached with all before it full sets the level
    level = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)
    rows = rows.withColumn("target", F.least(F.col("limit"), F.coalesce(level["level"] * F.col("weight"), F.col("limit"))))
    return rows.select("source", "source_size", F.col("target").cast("double").alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) from the source's name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\x00")))), 1, 8), 16, 10).cast("double") / 2.0**32


def _copied(docs: DataFrame, row: list[Column], *, weights: list[int] | None = None, budget: float = 1.5, cap: float = 2.0, seed: str = "mix:") -> DataFrame:
    """documents -> ``row``, doc_id, size, source_size, target, copies."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # rows of one doc_id and size come in order of all their columns' hash (but maps, which have none), so a rerun takes the same ones; equal rows by their place
    whole = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t))
    rows = docs.select(*row, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), whole.alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    rows = ranked(rows, ["source"], ["size", "_key", "doc_id", "_hash", "_at"])
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights or [5, 2, 1], budget, cap).withColumnRenamed("source", "_source")
    rows = rows.join(small(settled(targets)), same(F.col("source"), F.col("_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    begin = F.floor(offset(F.col("source"), seed) + F.col("rank") * each)
    end = F.floor(offset(F.col("source"), seed) + (F.col("rank") + 1) * each)
    return rows.withColumn("copies", F.least(end - begin, F.lit(cap).cast("long")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """documents -> doc_id, size, source_size, target, copies, taken. ``how``: weights, budget, cap, seed."""
    return _copied(docs, [], **how).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, all columns, each as often as it is taken. Whole rows are ranked, so that none is looked up again."""
    rows = _copied(docs, [F.struct(*docs.columns).alias("_whole")], **how).where("copies > 0")
    return rows.select("_whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_whole.*")
