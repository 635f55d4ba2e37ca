"""Two tables held against each other by key: what both have, what one lacks, and what differs where.

Both sides are tagged, put together and grouped once by the key columns (nulls are equal), so a key that either side
repeats is counted, not multiplied, and a hot key is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left_<value>, right_<value> (the least of a side's values), n_left, n_right, ``status``.

    ``status`` is left_only, right_only, equal, or unequal; null equals null, and a side that repeats a key with other values is unequal.
    """
    tagged = [d.select(*keys, F.lit(k).alias("_side"), F.col(value).alias("_v")) for k, d in enumerate((left, right))]
    of = lambda k, f: f(F.when(F.col("_side") == k, F.col("_v")))
    n = [F.count_if(F.col("_side") == k) for k in (0, 1)]
    values = [F.count_if((F.col("_side") == k) & F.col("_v").isNull()) for k in (0, 1)]
    rows = tagged[0].unionByName(tagged[1]).groupBy(*keys).agg(
        of(0, F.min).alias(f"left_{value}"), of(1, F.min).alias(f"right_{value}"), n[0].alias("n_left"), n[1].alias("n_right"),
        (of(0, F.min).eqNullSafe(of(1, F.min)) & of(0, F.max).eqNullSafe(of(1, F.max)) & of(0, F.min).eqNullSafe(of(0, F.max)) & ((values[0] == n[0]) == (values[1] == n[1])) & (values[0].isin(0) | (values[0] == n[0])) & (values[1].isin(0) | (values[1] == n[1]))).alias("_same"),
    )
    status = F.when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").when(F.col("_same"), "equal").otherwise("unequal")
    return rows.withColumn("status", status).drop("_same")


def totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of :func:`reconciled`'s statuses, and of keys that a side repeats."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy(*(by or [])).agg(of("equal"), of("unequal"), of("left_only"), of("right_only"), F.count_if((F.col("n_left") > 1) | (F.col("n_right") > 1)).alias("repeated"))


def first_difference(a: Column, b: Column, longest: int = 1 << 24) -> Column:
    """How many characters two texts share from the start; null if they are equal or one is null. Texts over ``longest`` are compared up to there.

    The length of the common prefix is found bit by bit, comparing twice as long prefixes first.
    """
    steps = F.array(*(F.lit(longest >> k) for k in range(longest.bit_length())))
    most = F.least(F.length(a), F.length(b))
    longer = lambda n, s: F.when((n + s <= most) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n)
    return F.when(a != b, F.aggregate(steps, F.lit(0), longer))


def flagged(rows: DataFrame, others: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """rows with whether their key columns stand among the others', nulls included; no row is added or lost."""
    marks = others.select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("_key")).distinct()
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col("_key")[f"k{i}"])
    return rows.join(marks, match, "left").select(*rows.columns, F.col("_key").isNotNull().alias(flag))


def with_defaults(rows: DataFrame, tags: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """rows with their tags (one row a key), or all defaults where there is no row of tags."""
    there = tags.select(*keys, F.struct(*defaults).alias("_tags"))
    none = F.struct(*(F.lit(v).cast(tags.schema[c].dataType).alias(c) for c, v in defaults.items()))
    return rows.join(there, keys, "left").select(*rows.columns, F.inline(F.array(F.coalesce("_tags", none))))


def own_or_default(rows: DataFrame, keys: list[str], there: Column, tags: dict[str, Column], defaults: dict[str, object]) -> DataFrame:
    """Keys and tags that rows have themselves, where ``there`` is true; a default for each that is missing."""
    return rows.select(*keys, *(F.coalesce(F.when(there, tags[c]), F.lit(v)).alias(c) for c, v in defaults.items()))


def offered(cells: DataFrame, taxonomy: DataFrame, trace: Column, collapsed: str) -> DataFrame:
    """Every cell with the categories that it may be given, in order.

    ``taxonomy`` has key, ord and requires_trace: with a trace all but the ``collapsed`` one are offered, without it that one
    and those that need none. The taxonomy is a list of categories.
    """
    fits = F.when(F.col("_trace"), F.col("key") != collapsed).otherwise(~F.col("requires_trace"))
    rows = cells.withColumn("_trace", F.coalesce(trace, F.lit(False))).join(F.broadcast(taxonomy.select("key", "ord", "requires_trace")), fits)
    return rows.select(*cells.columns, F.col("key").alias("category"), F.row_number().over(_in_order(cells.columns)).alias("place"))


def _in_order(columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*columns).orderBy("ord")


def denominators(labels: DataFrame, local: DataFrame, keys: list[str], cause: str = "cause", passed: str = "passed") -> DataFrame:
    """Per cause: labels that the local majority also fails (``n``), that it passes, and that it does not have (``dropped``); ``labels`` has one row a key."""
    verdicts = local.select(*keys, F.struct(F.col(passed).alias("p")).alias("_own"))
    rows = labels.join(verdicts, keys, "left")
    own = F.col("_own.p")
    return rows.groupBy(cause).agg(F.count_if(own == F.lit(False)).alias("n"), F.count_if(own).alias("passes"), F.count_if(F.col("_own").isNull()).alias("dropped"))


def marker_forensics(decodes: DataFrame, by: list[str], text: str, marker: str = "===FINAL===", word: str = "FINAL", least: int = 3, tail: int = 15) -> DataFrame:
    """Per group: rows, those with the marker, those with its word, those that end, spaces aside, in a piece of it of ``least`` characters or more."""
    end = F.right(F.regexp_replace(text, r"\s+$", ""), F.lit(tail))
    piece = F.exists(F.array(*(F.lit(marker[:k]) for k in range(least, len(marker)))), lambda p: end.endswith(p))
    return decodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(text).contains(marker)).alias("full_marker"), F.count_if(F.col(text).contains(word)).alias("has_word"), F.count_if(piece).alias("ends_in_piece")
    )
