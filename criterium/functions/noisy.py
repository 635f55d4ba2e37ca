"""JSON in noisy text, as Column functions: the first array that parses, the object between the outer braces.

JSON is the standard's: NaN, single quotes and bare control characters are none. Null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fenced block, with or without the name json. Fixed value.
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedControlChars": "false"}
_SPACE = " \t\n\r\x0b\f"
#: How a bracket and what stands up to the next one may begin an array.
_BEGINS = r"^\[\s*(?:[\]{\"0-9-]|true|false|null|\z)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: an expression that stands in several places of a lambda is worked out in each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def balanced_prefix(text: Column, pair: str = "[]") -> Column:
    """From the bracket that a text begins with to the one that closes it, brackets in strings aside; null where none does.

    Depth, quotes and escapes are folded over the pieces between quotes, backslashes and brackets. Runs with an even number
    of quotes and without the other two change nothing, in a string and out of it, so up to 50 such pairs are one piece.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        plain = ~s["escaped"]
        quote, back = plain & (piece == '"'), plain & s["quoted"] & (piece == "\\")
        depth = s["depth"] + F.when(s["quoted"], 0).when(piece == pair[0], 1).when(piece == pair[1], -1).otherwise(0)
        at = s["at"] + F.length(piece)
        after = F.struct(depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), back.alias("escaped"), at.alias("at"), F.when(depth == 0, at).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(after)

    marks = rf'"\\\{pair[0]}\{pair[1]}'
    pieces = rf'(?<!\\)(?:"[^{marks}]*+"[^{marks}]*+){{1,50}}+|[{marks}]|[^{marks}]+'
    end = lambda t: F.aggregate(F.regexp_extract_all(t, F.lit(pieces), F.lit(0)), start, step)["end"]
    return _once(text, lambda t: _once(end(t), lambda e: F.when(e > 0, F.substring(t, F.lit(1), e))))


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACE))


def _parsed(text: Column) -> Column:
    """A balanced text that is a JSON array, else null."""
    return _once(text, lambda t: F.when(F.from_json(t, "array<string>", _STRICT).isNotNull(), t))


def _array(text: Column) -> Column:
    """A text that is a JSON array as a whole, else null. The parser alone would not look behind the array."""
    return F.when(text.startswith("[") & (balanced_prefix(text) == text), _parsed(text))


def first_json_array(text: Column) -> Column:
    """The first JSON array of a noisy text: a fenced block that is one, else the whole text, else the first balanced
    ``[...]`` that parses; null without any. A bracket is tried only if no earlier one gave an array, and what may begin one follows it."""

    def found(t: Column) -> Column:
        whole = F.concat(F.transform(F.regexp_extract_all(t, F.lit(FENCE), F.lit(1)), _trimmed), F.array(_trimmed(t)))
        direct = F.aggregate(whole, F.lit(None).cast("string"), lambda had, part: F.coalesce(had, _array(part)))

        def step(s: Column, piece: Column) -> Column:
            tail = F.substring(t, s["at"] + 1, F.length(t))
            own = F.when(piece.rlike(_BEGINS), _parsed(balanced_prefix(tail)))
            return F.struct(F.coalesce(s["found"], own).alias("found"), (s["at"] + F.length(piece)).alias("at"))

        none = F.struct(F.lit(None).cast("string").alias("found"), F.lit(0).alias("at"))
        inner = F.aggregate(F.regexp_extract_all(t, F.lit(r"\[[^\[]*+|[^\[]++"), F.lit(0)), none, step)["found"]
        return F.when(t.contains("[") & t.contains("]"), F.coalesce(direct, inner))

    return _once(text, found)


def json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, where that is a JSON object; else null."""
    whole = lambda p: F.when((balanced_prefix(p, "{}") == p) & F.from_json(p, "map<string,string>", _STRICT).isNotNull(), p)
    return _once(F.regexp_extract(text, r"(?s)\{.*\}", 0), whole)


def entries(text: Column, field: str, keep: Callable[[Column], Column], most: int) -> Column:
    """Of the text's JSON object, the objects in the list ``field`` that ``keep`` takes (as JSON), at most ``most``, in order.

    Null without an object; an empty array where the field is no list or nothing is kept.
    """

    def of(whole: Column) -> Column:
        listed = F.from_json(F.get_json_object(whole, f"$.{field}"), "array<string>")
        kept = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda e: e.startswith("{") & F.coalesce(keep(e), F.lit(False)))
        return F.when(whole.isNotNull(), F.slice(kept, 1, most))

    return _once(json_object(text), of)


def synthesis(text: Column, categories: list[str]) -> Column:
    """What a synthesis answer holds: comparison, review and note, at most three recommendations of known categories, and
    ``error`` where there is no object or no such recommendation (then all else is null)."""
    of = lambda e, name: F.trim(F.coalesce(F.get_json_object(e, f"$.{name}"), F.lit("")))
    kept = entries(text, "recommendations", lambda e: F.get_json_object(e, "$.category").isin(*categories), 3)
    recommendations = F.transform(kept, lambda e: F.struct(F.get_json_object(e, "$.category").alias("category"), *(of(e, n).alias(n) for n in ("action", "rationale", "expected_signal"))))
    whole = json_object(text)
    texts = lambda name: F.coalesce(F.from_json(F.get_json_object(whole, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    error = F.when(whole.isNull(), "no object").when(F.size(kept) == 0, "no valid recommendation")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(
        good(texts("comparison")).alias("comparison"), good(texts("prior_recommendations_review")).alias("review"), good(recommendations).alias("recommendations"),
        good(of(whole, "iteration_note")).alias("note"), error.alias("error"),
    )
