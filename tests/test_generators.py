"""Table-valued functions: generated specifications and parses."""

import json

import pytest
from pyspark.sql import functions as F

from criterium.functions import generators as G
from criterium.functions import verifiers


def test_every_kind_has_a_spec_that_its_check_takes(spark):
    df = spark.createDataFrame([("",)], "t string")
    for kind in verifiers.CHECKS:
        for key in "abcdef":
            words, spec = G.generate(kind, G.Draws(1, key))
            assert words and spec["type"] == kind and json.loads(json.dumps(spec)) == spec
            verifiers.check(F.col("t"), spec)
        df.select(verifiers.check(F.col("t"), spec).alias("x")).collect()
    with pytest.raises(KeyError):
        G.generate("rhymes", G.Draws(1, "a"))


def test_specs_do_not_depend_on_partitions(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "coverage").otherwise("precision").alias("archetype"), F.lit("x").alias("spec"))
    rows = rows.unionByName(spark.createDataFrame([(None, "coverage", "x"), (7, None, "x")], "id long, archetype string, spec string"))
    got = [sorted((r["id"], r["position"], r["type"], r["spec"]) for r in G.with_generated(rows.drop("spec").repartition(n), "id", "archetype", 3).collect()) for n in (1, 5)]
    assert got[0] == got[1] and {r[0] for r in got[0]} == set(range(40))
    for k in range(40):
        draws = G.Draws(3, str(k))
        kinds = G.kinds_for("coverage" if k % 2 == 0 else "precision", draws)
        assert [(r[1], r[2], json.loads(r[3])) for r in got[0] if r[0] == k] == [(i, t, G.generate(t, draws)[1]) for i, t in enumerate(kinds)]
        assert len(set(kinds)) == len(kinds) and len(kinds) in ((6, 7) if k % 2 == 0 else (3, 4))


def test_prompts(spark):
    rows = spark.createDataFrame([("p", "coverage"), ("q", "precision"), ("q", "precision")], "id string, archetype string")
    found = {r["id"]: r for r in G.composed(rows, "id", "archetype", 3).collect()}
    assert "Requirements:\n- " in found["q"]["prompt"] and "\n" not in found["p"]["prompt"] and len(found) == 2
    for r in found.values():
        assert r["domain"] in G.STEMS and any(r["prompt"].startswith(s) for s in G.STEMS[r["domain"]])
        assert [json.loads(s)["type"] for s in r["specs"]] == r["constraint_types"] == G.kinds_for(r["archetype"], G.Draws(3, r["id"]))


def test_words():
    assert [G.listed(x) for x in (["a"], ["a", "b"], [1, 2, 3])] == ["a", "a and b", "1, 2, and 3"]
    assert G.counted("min", 2, "times") == "at least 2 times"


def halves(text, stop_reason):
    if stop_reason == "refusal":
        raise ValueError("declined")
    return [(i, p) for i, p in enumerate(text.split(";"))]


def test_parses_of_many_rows(spark):
    parse = G.parsing(halves, "place int, part string")
    rows = spark.createDataFrame([(1, "a;b", None), (2, "", "stop"), (3, "c", "refusal"), (4, None, None)], "id int, text string, stop string")
    found = rows.lateralJoin(parse(F.col("text").outer(), F.col("stop").outer())).select("id", "place", "part", "error").collect()
    assert sorted(tuple(r)[:3] for r in found if r["error"] is None) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]
    assert [tuple(r) for r in found if r["error"]] == [(3, None, None, "ValueError: declined")]
