"""Seeded selection: samples, quotas, round robin, greedy coverage.

Order comes from ``md5(seed:key)``, so a sample is the same on every run and machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_of(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows without replacement."""
    return df.withColumn("draw", key_of(seed, *keys)).orderBy("draw", *keys).limit(n)


def stratified(df: DataFrame, stratum: list[str], keys: list[str], quota: Column | int, seed: int) -> DataFrame:
    """The first ``quota`` rows of each stratum in hashed order."""
    order = Window.partitionBy(*stratum).orderBy(key_of(seed, *keys), *keys)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota)


def hashed_places(df: DataFrame, stratum: list[str], keys: list[str], seed: int, place: str, total: str | None = None) -> DataFrame:
    """Every row's ``place`` from 1 within its stratum in hashed order, and the stratum's size.

    A hash's first three digits cut a stratum into 4,096 even parts in order; rows are ranked within a part and
    the parts' sizes, at most 4,096 rows a stratum, supply the rest. A hot stratum so spreads over many tasks.
    """
    draw, part, at = (unused(df, x) for x in ("_draw", "_part", "_place"))
    rows = df.withColumn(draw, key_of(seed, *keys)).withColumn(part, F.left(draw, F.lit(3)))
    parts = rows.groupBy(*stratum, part).agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*stratum)
    before = within.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"), F.sum("_n").over(within).alias("total")]
    parts = parts.select(F.struct(*(F.col(s).alias(f"s{i}") for i, s in enumerate(stratum)), F.col(part).alias("p"), *sums).alias(unused(df, "_parts")))
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(*stratum, part).orderBy(draw, *keys)))
    other = F.col(unused(df, "_parts"))
    match = F.col(part) == other["p"]
    for i, s in enumerate(stratum):
        match = match & F.col(s).eqNullSafe(other[f"s{i}"])
    found = [(F.col(at) + other["before"]).alias(place)] + ([other["total"].alias(total)] if total else [])
    return rows.join(parts, match).select(*df.columns, *found)


def proportional(df: DataFrame, stratum: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows spread evenly over the strata: each gets n div strata, the first n mod strata by name one more."""
    names = df.select(stratum).distinct()
    order = Window.orderBy(stratum)  # one row a stratum
    size = F.count(F.lit(1)).over(Window.partitionBy())
    quotas = names.select(F.col(stratum).alias("_s"), (F.floor(F.lit(n) / size) + (F.row_number().over(order) <= F.lit(n) % size).cast("int")).alias("quota"))
    rows = df.join(quotas, F.col(stratum).eqNullSafe(F.col("_s")))
    return stratified(rows, [stratum], keys, n, seed).where("place <= quota").drop("_s", "quota")  # tasks send n rows a stratum at most


def parity(df: DataFrame, group: str, keys: list[str], seed: int) -> DataFrame:
    """As many rows of each group as the smallest has."""
    least = df.groupBy(group).count().agg(F.min("count").alias("least"))
    return hashed_places(df, [group], keys, seed, "place").crossJoin(F.broadcast(least)).where("place <= least").drop("least")  # one row


def round_robin(df: DataFrame, stratum: str, keys: list[str], seed: int) -> DataFrame:
    """Rows with ``turn`` and ``stratum_size``; in order of turn, size descending and name they alternate between strata."""
    return hashed_places(df, [stratum], keys, seed, "turn", "stratum_size")


def split_by_place(df: DataFrame, group: list[str], order: list[str], train: int) -> DataFrame:
    """The first ``train`` rows of each group are for training, the rest held out; the order identifies a group's rows.

    Only a group's first rows are ranked, of which a task sends ``train`` at most; the last of them is the limit for all.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    last = df.select(*group, *order).withColumn("_place", place).where(F.col("_place") <= train)
    last = last.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.max(F.struct(*order)).alias("_last"))
    match = F.lit(True)
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    split = F.when(F.struct(*order) <= F.col("_last"), "train").otherwise("holdout").alias("split")
    return df.join(last, match, "left").select(*df.columns, split)


def drop_exact_duplicates(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each text by ``order``, with the number of rows dropped for it; a hash is shuffled, not a window over texts."""
    rest = [c for c in df.columns if c != order]
    rows = df.groupBy(F.md5(text).alias("_digest")).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("first"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return rows.select("first.*", "dropped").select(*df.columns, "dropped")


def half_each(df: DataFrame, group: str, key: str, names: tuple[str, str], n: int, seed: int) -> DataFrame:
    """n keys: the first n / 2 of either group in hashed order, keys of both once, then the first of all others until there are n."""
    halves = stratified(df.where(F.col(group).isin(*names)).select(group, key).distinct(), [group], [key], n // 2, seed).select(key).distinct()
    others = sample(df.select(key).distinct().join(halves, key, "left_anti"), [key], n, seed)  # at most n rows
    place = F.row_number().over(Window.orderBy("draw", key))
    short = halves.agg((F.lit(n) - F.count(F.lit(1))).alias("short"))  # one row
    more = others.withColumn("place", place).crossJoin(F.broadcast(short)).where("place <= short")
    return halves.withColumn("topped_up", F.lit(False)).unionByName(more.select(key, F.lit(True).alias("topped_up")))


def turns_of(sizes: dict, n: int) -> dict:
    """How many of n turns each stratum gets when those with rows left take turns, the largest first, then by name."""
    out, left = dict.fromkeys(sizes, 0), min(n, sum(sizes.values()))
    while left:
        live = [u for u in _turn_order(sizes) if out[u] < sizes[u]]
        whole = min(left // len(live), min(sizes[u] - out[u] for u in live))
        for u in live if whole else live[:left]:
            out[u] += max(1, whole)
            left -= max(1, whole)
    return out


def _turn_order(sizes: dict) -> list:
    return sorted(sizes, key=lambda u: (-sizes[u], u is None, u))


def covering(df: DataFrame, n: int, seed: int, stratum: str = "use_case", covers: tuple[str, ...] = ("instruction_type", "prompt_style"), key: str = "id") -> DataFrame:
    """n of the rows, chosen greedily: strata take turns, the largest first, and each turn takes the row that covers most
    values not yet covered, the first in hashed order among equals.

    What a row covers anew only shrinks, so a stratum's best row stays its best as long as its own count of new values
    stands. An aggregation gives every stratum's best at once; the driver keeps these (a row a stratum) and the values
    covered, and asks again only when the best of the stratum in turn has lost a value. Rows that cover something new
    are never taken twice, and there are no more of them than values; all other turns take a stratum's first rows in
    hashed order, however many, without the driver.
    """
    draw = unused(df, "_draw")
    rows = df.withColumn(draw, key_of(seed, key))
    kinds = rows.groupBy(stratum, *covers).agg(F.min(F.struct(draw, key)).alias("head"), F.count(F.lit(1)).alias("rows"))
    sizes = {r[stratum]: r["rows"] for r in kinds.groupBy(stratum).agg(F.sum("rows").alias("rows")).collect()}  # a row a stratum
    turns = turns_of(sizes, n)
    seen: tuple[set, ...] = tuple(set() for _ in covers)

    def fresh(values) -> int:
        return sum(v not in s for v, s in zip(values, seen))

    def ask() -> dict:
        new = sum((F.when(F.col(c).isNull(), F.lit(int(None not in s))).otherwise((~F.col(c).isin([v for v in s if v is not None])).cast("int")) for c, s in zip(covers, seen)), F.lit(0))
        best = kinds.where(new > 0).groupBy(stratum).agg(F.min_by(F.struct(new.alias("new"), "head", *covers), F.struct(-new, "head")).alias("best"))
        return {r[stratum]: r["best"] for r in best.collect()}

    best, taken, turn = ask() if n > 0 else {}, [], 0
    while best:
        for u in _turn_order(sizes):
            if u in best and turn < turns[u]:
                if fresh([best[u][c] for c in covers]) < best[u]["new"]:
                    best = ask()
                if u in best:
                    taken.append((u, best[u]["head"][key]))
                    for c, s in zip(covers, seen):
                        s.add(best[u][c])
        turn += 1
        best = {u: b for u, b in best.items() if turn < turns[u]}
    spark = df.sparkSession
    covering_rows = spark.createDataFrame([(k,) for _, k in taken], f"_k {df.schema[key].dataType.simpleString()}")  # no more than values
    left = [(u, t - sum(v == u for v, _ in taken)) for u, t in turns.items()]
    quotas = spark.createDataFrame(left, f"_s {df.schema[stratum].dataType.simpleString()}, _left int")  # a row a stratum
    first = rows.join(F.broadcast(covering_rows), F.col(key) == F.col("_k"), "left_semi")
    others = rows.join(F.broadcast(covering_rows), F.col(key) == F.col("_k"), "left_anti").join(F.broadcast(quotas), F.col(stratum).eqNullSafe(F.col("_s")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))
    most = max((q for _, q in left), default=0)
    rest = others.withColumn("_place", place).where((F.col("_place") <= most) & (F.col("_place") <= F.col("_left")))  # tasks send so many rows a stratum at most
    return first.select(*df.columns).unionByName(rest.select(*df.columns))
