"""JSON in noisy texts against a plain parser."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from criterium.functions import noisy


def no_constant(name):
    raise ValueError(name)


def loads(part):
    try:
        return json.loads(part, parse_constant=no_constant)
    except ValueError:
        return None


def plain_prefix(text):
    depth, at = 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|["\[\]]', text, re.S):
        if m[0] == '"':
            return None  # a string without an end
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "]":
            return text[: m.end()]
    return None


def plain_array(text):
    parts = [p.strip() for p in re.findall(r"```(?:json)?\s*(.*?)\s*```", text, re.S | re.I)] + [text.strip()]
    parts += [p for i, c in enumerate(text) if c == "[" and (p := plain_prefix(text[i:]))]
    return next((p for p in parts if isinstance(loads(p), list)), None)


def plain_object(text):
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if 0 <= a < b and isinstance(loads(text[a : b + 1]), dict) else None


def drawn(seed, n):
    draw = random.Random(seed)
    parts = ["[", "]", "{", "}", '"', "\\", '\\"', "1", ",", " ", "a", '"x"', '"]"', '{"k": [1, "["]}', "[1, 2]", "```json\n", "```", "```", "null", "[]", "é", "\n", ":", "[[", "]]", "NaN", "-0.5e3", "01"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(16))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_array_on_noise(spark, seed):
    texts = drawn(seed, 1500)
    texts += ["".join(random.Random(seed * 99 + i).choice(['{"a": ', "1", "}", "{}", " ", "'b'", '"}"', "x", '{"c": {}}']) for _ in range(4)) for i in range(400)]
    want = [(plain_array(t), plain_object(t)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", noisy.first_json_array(F.col("t")).alias("x"), noisy.json_object(F.col("t")).alias("o")).collect()
    got = [(r["x"], r["o"]) for r in sorted(rows, key=lambda r: r["i"])]
    assert sum(w is not None for w, _ in want) > 100 and sum(w is not None for _, w in want) > 50
    for t, g, w in zip(texts, got, want):
        assert g == w, t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('so: ["]", 1] and [2]', '["]", 1]'), ("```json\n[3]\n```", "[3]"), ("```\n{}\n``` [4]", "[4]"), ("none [", None), ("", None), (" [1, [2, 3]] ", "[1, [2, 3]]"), ("[1] junk", "[1]"),
        ('["a\\"]"] x', '["a\\"]"]'), ("[ [1] ", "[1]"), ("[no] [yes] [5]", "[5]"), ("```json [1] junk ``` [2]", "[1]"), ("[NaN] [6]", "[6]"),
    ],
)
def test_first_array(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(noisy.first_json_array(F.col("t")).alias("x")).first()["x"] == want == plain_array(text)


def test_null_and_long_texts(spark):
    long = "x" * 50_000 + '["' + "\\\\" * 20_000 + '"]' + "y" * 50_000
    rows = spark.createDataFrame([(0, None), (1, long), (2, "[" * 300), (3, "]" * 100_000)], "i int, t string").select("i", noisy.first_json_array(F.col("t")).alias("x"), noisy.json_object(F.col("t")).alias("o")).collect()
    assert {r["i"]: r["x"] for r in rows} == {0: None, 1: '["' + "\\\\" * 20_000 + '"]', 2: None, 3: None} and all(r["o"] is None for r in rows)


def test_documents(spark, data):
    """Whole documents with an array set in the middle, and without."""
    docs = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000").limit(60).collect()]
    texts = [t[: len(t) // 2] + f' ["q", {{"k": [{i}]}}] ' + t[len(t) // 2 :] if i % 2 else t for i, t in enumerate(docs)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", noisy.first_json_array(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: plain_array(t) for i, t in enumerate(texts)}


def test_entries_and_synthesis(spark):
    text = 'Sure: {"comparison": ["up", 3], "recommendations": [{"category": "data", "action": " add "}, 7, "x", {"category": "other"}, {"category": "judge", "rationale": null}, {"category": "data"}, {"category": "data", "action": "fourth"}], "iteration_note": " n "} bye'
    texts = [text, "no object", '{"recommendations": []}', '{"recommendations": {"category": "data"}}', '{"recommendations": [{"category": "data"}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", noisy.synthesis(F.col("t"), ["data", "judge"]).alias("s"), noisy.entries(F.col("t"), "recommendations", lambda e: F.lit(True), 9).alias("e")).orderBy("i").collect()
    s = rows[0]["s"]
    assert [(r["category"], r["action"], r["rationale"], r["expected_signal"]) for r in s["recommendations"]] == [("data", "add", "", ""), ("judge", "", "", ""), ("data", "", "", "")]
    assert s["comparison"] == ["up", "3"] and s["review"] == [] and s["note"] == "n" and s["error"] is None
    assert [r["s"]["error"] for r in rows[1:]] == ["no object", "no valid recommendation", "no valid recommendation", "no object", "no object"]
    assert [None if r["e"] is None else len(r["e"]) for r in rows] == [5, None, 0, 0, None, None]
    assert all(r["s"]["recommendations"] is None for r in rows[1:])


def test_a_text_is_cut_once_a_place(spark):
    """Pieces, brackets and parses stand in a plan once for every place they are worked out for, however deep they nest."""
    rows = spark.createDataFrame([("see [1]",)], "t string")
    array, kept = rows.select(noisy.first_json_array(F.col("t")).alias("x")), rows.select(noisy.entries(F.col("t"), "items", lambda e: F.lit(True), 2).alias("x"))
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert plan(array).count("regexp_extract_all(") <= 5 and plan(kept).count("regexp_extract_all(") == 1


@pytest.mark.parametrize("text, want", [('x [] y', "[]"), ('[no] [\n"a\\"]"] z', '[\n"a\\"]"]'), ('" [ "q [[1], "b]"] ] [2]', '[[1], "b]"]'), ('[' + '"s", ' * 120 + '"]"]', '[' + '"s", ' * 120 + '"]"]'), ('["a" "b"] [nul] [ -1 ]', "[ -1 ]")])
def test_brackets_between_many_strings(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(noisy.first_json_array(F.col("t")).alias("x")).first()["x"] == want
