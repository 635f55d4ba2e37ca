"""Column functions over text: stripping, tokens, answer extraction, loops, shapes of JSON in noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def words(text: Column) -> Column:
    """Runs of non-white characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def after_last(text: Column, marker: str) -> Column:
    """What follows the last ``marker``, or the whole text."""
    return F.element_at(F.split(text, f"\\Q{marker}\\E"), -1)


def final_answer(text: Column, marker: str = "===FINAL===") -> Column:
    return strip(after_last(text, marker))


def without_reasoning(text: Column, marker: str = "</think>") -> Column:
    return after_last(text, marker)


def has_reasoning(text: Column) -> Column:
    return text.rlike(r"(?s)<think>.*?</think>")


def clip_middle(text: Column, limit: int, marker: str) -> Column:
    """Texts over ``limit`` characters as their first two thirds, ``marker``, and last third of the limit."""
    head = limit * 2 // 3
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(limit - head)))).otherwise(text)


def numbered(items: Column) -> Column:
    """``1. a`` newline ``2. b`` ..."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def english_list(items: Column) -> Column:
    """a / a and b / a, b, and c."""
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(most, F.lit(", and "), F.element_at(items, -1)))
    )


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: Column, n: int, one) -> Column:
    """``one`` of each n consecutive lower-cased words, distinct; none if there are fewer words."""

    def spans(tokens: Column) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: one(F.slice(tokens, i, n))))

    return bound(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1)), spans)


def ngrams(text: Column, n: int) -> Column:
    """The distinct n-grams of the lower-cased words, joined by a space."""
    return _spans(text, n, lambda words: F.array_join(words, " "))


def ngram_hashes(text: Column, n: int) -> Column:
    """Their 64-bit hashes, without building the strings."""
    return _spans(text, n, F.xxhash64)


def criterion_id(prompt: Column, index: Column, kind: Column) -> Column:
    return F.format_string("%s#c%02d:%s", prompt, index, kind)


def kind_of(criterion: Column) -> Column:
    return F.element_at(F.split(criterion, ":"), -1)


def cell_id(model: Column, prompt: Column) -> Column:
    """``model__prompt``; a model that holds the separator is an error."""
    return F.when(model.contains("__"), F.raise_error(F.lit("model id holds the separator"))).otherwise(F.concat_ws("__", model, prompt))


def short_digest(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def duration(seconds: Column) -> Column:
    """``1h02m``, ``3m04s`` or ``5s``."""
    s = seconds.cast("long")
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
        .when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%ds", s))
    )
