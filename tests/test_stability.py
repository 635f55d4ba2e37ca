"""Weighted draws against plain sums, and the composite on cases worked out by hand."""

import random
from hashlib import md5
from math import exp, factorial

import pytest
from pyspark.sql import functions as F

from criterium.operators import resample, stability


def weight(seed, draw, key):
    bits = int(md5(f"{seed}:{draw // 4}:{key}".encode()).hexdigest()[8 * (draw % 4) :][:8], 16)
    k, below = 0, exp(-1)
    while bits >= int(below * 2**32) and k < 11:
        k += 1
        below += exp(-1) / factorial(k)
    return k


def test_sums_are_those_of_the_weights(spark):
    rows = [(g, k, random.Random(k).randrange(9)) for g in ("x", "y") for k in range(40)]
    df = spark.createDataFrame(rows, "g string, key long, n long")
    got = {(r["g"], r["draw"]): r["n"] for r in resample.resampled_sums(df, "key", ["n"], 10, 5, ["g"]).collect()}
    assert got == {(g, b): sum(weight(5, b, k) * n for h, k, n in rows if h == g) for g in ("x", "y") for b in range(10)}
    again = {(r["g"], r["draw"]): r["n"] for r in resample.resampled_sums(df.repartition(7), "key", ["n"], 10, 5, ["g"]).collect()}
    assert again == got


def test_weights_have_the_distribution(spark):
    df = spark.range(20_000).select(F.col("id").alias("key"), F.lit(1).alias("n"))
    ones = [r["n"] / 20_000 for r in resample.resampled_sums(df, "key", ["n"], 40, 3).collect()]
    assert abs(sum(ones) / 40 - 1) < 0.004
    drawn = [weight(3, b, k) for b in range(8) for k in range(5000)]
    for k in range(5):
        assert drawn.count(k) / len(drawn) == pytest.approx(exp(-1) / factorial(k), abs=0.01)


CAUSES = ["a", "b", "c", "d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, prompt_id long, root_cause string")


def cuts(spark, rows):
    return stability.clusters(frame(spark, rows), "run", "e", "l", CAUSES)


def many(run, prompts, causes):
    return [(run, p, c) for p in prompts for c in causes]


def test_cuts_share_prompts(spark):
    rows = many("e", range(3), "aab") + many("l", range(2, 6), "bc") + [("other", 1, "a"), ("e", 9, None), ("l", 9, "unknown"), (None, 1, "a")]
    found = {(r["cut"], r["root_cause"]): (r["n"], r["rank"], r["n_rows"], r["n_prompts"]) for r in stability.ranking(cuts(spark, rows), CAUSES).collect()}
    assert found == {
        ("earlier", "a"): (6, 1, 9, 3), ("earlier", "b"): (3, 2, 9, 3), ("later", "b"): (4, 1, 8, 4), ("later", "c"): (4, 2, 8, 4),
        ("later_shared", "b"): (1, 1, 2, 1), ("later_shared", "c"): (1, 2, 2, 1), ("later_disjoint", "b"): (3, 1, 6, 3), ("later_disjoint", "c"): (3, 2, 6, 3),
    }


def test_equal_clusters_have_no_width_and_concentrated_ones_more(spark):
    even = many("e", range(30), "ab")
    row = {r["root_cause"]: r for r in stability.cut_table(cuts(spark, even), CAUSES, 40, 1).collect()}
    assert row["a"]["lo"] == row["a"]["hi"] == 0.5
    spread = [("e", p, "a" if p % 2 else "b") for p in range(60)]
    clumped = [("e", p, "a") for p in range(3) for _ in range(10)] + [("e", p + 30, "b") for p in range(30)]
    width = lambda rows: next(r["hi"] - r["lo"] for r in stability.cut_table(cuts(spark, rows), CAUSES, 200, 1).collect() if r["root_cause"] == "a")
    assert width(clumped) > 1.5 * width(spread) > 0


def test_decision(spark):
    table = lambda rows: stability.cut_table(cuts(spark, rows), CAUSES, 40, 1)
    earlier = many("e", range(20), "aaabbc")
    same = stability.decision(table(earlier + many("l", range(10, 40), "aaabbc"))).first()
    assert same["earlier_top"] == same["later_top"] == "a,b,c" and same["set_holds"] and same["n_overlap"] == 3 and same["confirmed"]
    moved = stability.decision(table(earlier + many("l", range(10, 40), "aaaaaaaabcd"))).first()
    assert moved["later_top"] == "a,b,c" and moved["set_holds"] and moved["n_overlap"] < 3 and not moved["confirmed"]
    other = stability.decision(table(earlier + many("l", range(10, 40), "aabbdd"))).first()
    assert other["later_top"] == "a,b,d" and not other["set_holds"] and not other["confirmed"]


def test_rank_agreement(spark):
    rows = many("e", range(4), "aaaabbbccd") + many("l", range(2, 6), "abbbccccdd")  # earlier a b c d, later c b d a
    found = {r["cut"]: (r["n_common"], r["tau"]) for r in stability.rank_agreement(stability.ranking(cuts(spark, rows), CAUSES)).collect()}
    assert found["later"][0] == 4
    order = {"a": 0, "b": 1, "c": 2, "d": 3}
    later = ["c", "b", "d", "a"]
    signs = [1 if order[x] < order[y] else -1 for i, x in enumerate(later) for y in later[i + 1 :]]
    assert found["later"][1] == pytest.approx(sum(signs) / len(signs), abs=1e-6)
    one = stability.rank_agreement(stability.ranking(cuts(spark, many("e", [1], "ab") + many("l", [2], "bc")), CAUSES)).collect()
    assert all(r["n_common"] == 1 and r["tau"] is None for r in one)


def test_deltas_and_empty_runs(spark):
    rows = many("e", range(20), "ab") + many("l", range(20), "ac")
    found = {r["root_cause"]: (r["lo"], r["hi"]) for r in stability.deltas(cuts(spark, rows), CAUSES, 20, 1).collect()}
    assert found == {"a": (0.0, 0.0), "b": (-0.5, -0.5), "c": (0.5, 0.5)}
    none = cuts(spark, [("x", 1, "a")])
    assert none.count() == 0 and stability.cut_table(none, CAUSES, 20, 1).count() == 0
    assert stability.decision(stability.cut_table(none, CAUSES, 20, 1)).first()["n_overlap"] == 0


def test_draws_without_failures_count_as_zero(spark):
    df = spark.createDataFrame([("RA", "x", 1, 1, 1), ("RA", "y", 2, 0, 0)], "arm string, cause string, prompt_id long, failed long, recovered long")
    found = {r["cause"]: (r["lo"], r["hi"]) for r in resample.recovery_intervals(df, 40, 3).collect()}
    assert found == {"x": (0.0, 1.0), "y": (0.0, 0.0)}  # a single prompt is not drawn in a third of the draws


def test_proxies(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True), ("b", True), ("c", False)], "root_cause string, ok boolean")
    found = {r["proxy"]: (r["n_rows"], r["top"], r["matches"]) for r in stability.proxies(rows, {"ok": "ok", "none": "ok is null"}, 2).collect()}
    assert found == {"full": (5, "a,b", True), "ok": (3, "a,b", True), "none": (1, "a", False)}


def test_recovery_in_one_aggregation_equals_the_two_steps(spark):
    from criterium.operators import estimands

    draw = random.Random(6)
    rows = [(draw.choice(["0", "A", "B", "C"]), draw.choice("xy"), draw.randrange(9), f"c{draw.randrange(3)}", draw.choice([True, False, None])) for _ in range(600)]
    records = spark.createDataFrame(rows, "arm string, cause string, prompt_id long, criterion_id string, passed boolean")
    for by in (None, ["cause", "prompt_id"]):
        one, two = estimands.recovery_of_records(records, ["A", "B", "gone"], by=by), estimands.recovery(estimands.majority(records), ["A", "B", "gone"], by=by)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_majority_of_named_arms_equals_that_of_rows(spark):
    from criterium.operators import estimands

    rows = [(a, "c", i % 7, f"k{i % 3}", p) for i, a in enumerate(["A", "B", None, "other", "A"] * 12) for p in (True, None, i % 2 == 0)]
    records = spark.createDataFrame(rows, "arm string, cause string, prompt_id int, criterion_id string, passed boolean")
    got, want = estimands.majority(records, ["A", "B", "gone"]), estimands.majority(records)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_weights_are_compared_as_digits(spark):
    """As numbers they are converted for every step; the digits sort alike."""
    bits = [b for s in resample.poisson_steps() for b in (s - 1, s, s + 1) if 0 <= b < 2**32] + [0, 2**32 - 1]
    got = spark.createDataFrame([(b, f"{b:08x}") for b in bits], "b long, t string").select("b", resample.weight_of(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [sum(r["b"] >= s for s in resample.poisson_steps()) for r in got]
