"""Raw records into complete, valid rows: verdicts, tags, diagnoses, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criterium.functions.text import strip

MISSING = "missing_in_judge_output"


def clean_criteria(df: DataFrame, prefix: str = "criterion_") -> Column:
    """The columns that begin with ``prefix``, in order, as an array without nulls and blanks."""
    found = [c for c in df.columns if c.startswith(prefix)]
    return F.filter(F.transform(F.array(*(F.col(c).cast("string") for c in found)), strip), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan"))


def numbered_slots(keys: DataFrame, n: str) -> DataFrame:
    """A row for every index from 1 to the column ``n``."""
    return keys.where(F.col(n) > 0).withColumn("index", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))


def last_by_index(parsed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Of rows (keys, ord, index as text, fields) with a whole-number index, the last one of each index."""
    rows = parsed.withColumn("index", F.expr("try_cast(trim(cast(index as string)) as bigint)")).where("index is not null")
    return rows.groupBy(*keys, "index").agg(F.max_by(F.struct(*fields), "ord").alias("last")).select(*keys, "index", *(F.col(f"last.{f}").alias(f) for f in fields))


def verdicts(parsed: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """``parsed`` (keys, ord, index, verdict, reason) against ``prompts`` (keys, n): exactly n rows each.

    Other verdicts than PASS and FAIL fail, missing rows fail with a reason of their own, of repeated
    indices the last counts, indices out of range are left out.
    """
    rows = last_by_index(parsed, keys, ["verdict", "reason"])
    verdict = F.upper(strip(F.col("verdict").cast("string")))
    rows = rows.withColumn("verdict", F.when(verdict == "PASS", "PASS").otherwise("FAIL")).withColumn("seen", F.lit(True))
    full = numbered_slots(prompts, "n").join(rows, [*keys, "index"], "left")
    return full.select(*keys, "index", F.coalesce("verdict", F.lit("FAIL")).alias("verdict"), F.when(F.col("seen"), F.coalesce("reason", F.lit(""))).otherwise(MISSING).alias("reason"))


def tags(parsed: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """``parsed`` (keys, ord, index, verifiability, gameable, reward_hack, ambiguous): exactly n rows each, with defaults."""
    rows = last_by_index(parsed, keys, ["verifiability", "gameable", "reward_hack", "ambiguous"])
    full = numbered_slots(prompts, "n").join(rows, [*keys, "index"], "left")
    gameable = F.coalesce("gameable", F.lit(False))
    return full.select(
        *keys, "index", F.when(F.col("verifiability").isin("auto", "judge"), F.col("verifiability")).otherwise("judge").alias("verifiability"),
        gameable.alias("gameable"), F.when(gameable, F.coalesce("reward_hack", F.lit(""))).otherwise("").alias("reward_hack"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )


def diagnosis_errors(rows: DataFrame, requested: DataFrame, allowed: list[str], keys: list[str]) -> DataFrame:
    """Per key, what is wrong with diagnoses ``rows`` (keys, index, root_cause) against ``requested`` (keys, index); null if nothing is."""
    n = rows.groupBy(*keys, "index").agg(F.count(F.lit(1)).alias("n"), F.max((~F.col("root_cause").isin(allowed)).cast("int")).alias("bad"))
    both = requested.select(*keys, "index").distinct().join(n, [*keys, "index"], "left")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("bad") == 1, "unknown_cause")
    return both.groupBy(*keys).agg(F.min(kind).alias("error"))


def output_state(stop: Column, parsed: Column) -> Column:
    """refusal, truncated, parse_error or ok, from a provider's stop reason and the parsed output."""
    reason = stop_reason(stop)
    return F.when(reason == "refusal", "judge_refusal").when(reason == "max_tokens", "judge_truncated").when(parsed.isNull(), "judge_parse_error").otherwise("ok")


def stop_reason(stop: Column) -> Column:
    """Stop reasons of several providers under one set of names."""
    return F.when(stop == "length", "max_tokens").when(stop.isNull() | stop.isin("content_filter", ""), "refusal").otherwise(stop)


def all_fail(keys: DataFrame, n: str, reason: str) -> DataFrame:
    """n failing rows with one reason."""
    return numbered_slots(keys, n).drop(n).withColumn("verdict", F.lit("FAIL")).withColumn("reason", F.lit(reason))


def messages(system: Column, user: Column) -> Column:
    """A chat as an array of role and content; a blank system prompt is left out."""
    chat = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.filter(chat, lambda m: (m["role"] != "system") | (strip(F.coalesce(m["content"], F.lit(""))) != ""))


def chats(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one row each: the turns in order, and their joined text."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("chat"))


def resolve_chain(attempts: DataFrame, keys: list[str], default: Column | None = None) -> DataFrame:
    """Of attempts (keys, member_ord, attempt, ok, result), the first success in order of chain and attempt."""
    best = F.min_by(F.when(F.col("ok"), F.col("result")), F.when(F.col("ok"), F.struct("member_ord", "attempt")))
    return attempts.groupBy(*keys).agg((F.coalesce(best, default) if default is not None else best).alias("result"), F.count(F.lit(1)).alias("attempts"))


def first_accepted(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Rejection sampling over stored attempts (keys, attempt, passed, answer, tokens): the first that passes all checks."""
    return attempts.groupBy(*keys).agg(
        F.min_by(F.when(F.col("passed"), F.col("answer")), F.when(F.col("passed"), F.col("attempt"))).alias("answer"),
        F.min(F.when(F.col("passed"), F.col("attempt"))).alias("accepted_at"), F.count(F.lit(1)).alias("attempts"), F.sum("tokens").alias("tokens"),
    )
