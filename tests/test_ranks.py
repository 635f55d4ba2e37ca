"""Order statistics against sorting and comparing all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from criterium.operators import progress, ranks


def all_pairs(x, y, w):
    return sum(int(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i))


@pytest.mark.parametrize("seed", range(6))
def test_concordance_equals_all_pairs(seed):
    r = np.random.default_rng(seed)
    n, values = [(0, 3), (1, 3), (2, 2), (37, 4), (64, 100), (130, 9)][seed]
    x, y, w = r.integers(0, values, n), r.integers(0, values, n).astype(float), r.integers(1, 4, n)
    assert ranks.concordance(x, y, w) == all_pairs(x, y, w)


@pytest.mark.parametrize("parts", [2, 5, 64])
def test_tau_equals_all_pairs(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice([None, 7, *range(40)]), draw.choice([None, 3.5, draw.random()])) for _ in range(300)] + [(7, draw.random()) for _ in range(150)] + [(1, float("nan")), (7, 3.5), (7, 3.5)]
    got = ranks.kendall_tau(spark.createDataFrame(rows, "a int, b double").repartition(3), "a", "b", parts).first()
    good = [r for r in rows if None not in r and r[1] == r[1]]
    n = len(good)
    want = all_pairs([r[0] for r in good], [r[1] for r in good], [1] * n)
    assert got["pairs"] == n * (n - 1) // 2 and got["tau"] == pytest.approx(want / (n * (n - 1) / 2), abs=1e-12)


def test_tau_without_pairs(spark):
    for rows in ([], [(1, 1.0)], [(None, 1.0), (2, None)]):
        got = ranks.kendall_tau(spark.createDataFrame(rows, "a int, b double"), "a", "b").first()
        assert got["pairs"] == 0 and got["tau"] is None
    assert ranks.kendall_tau(spark.createDataFrame([(1, 1.0)] * 5, "a int, b double"), "a", "b").first()["tau"] == 0


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_elements_at_ranks(spark, accuracy):
    draw = random.Random(accuracy)
    rows = [("hot", draw.choice([5, draw.randrange(10_000)])) for _ in range(3000)] + [(draw.choice(["a", None]), draw.randrange(50)) for _ in range(200)] + [("one", 4), ("none", None), ("hot", None)]
    at = {"least": (0.0, lambda n: F.lit(0)), "q": (0.3, lambda n: F.floor(0.3 * n)), **ranks.MIDDLE, "p99": (0.99, lambda n: F.floor(0.99 * n)), "most": (1.0, lambda n: n - 1)}
    got = {r["k"]: r for r in ranks.elements_at(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], "v", at, accuracy).collect()}
    assert set(got) == {"hot", "a", None, "one"}
    for k, r in got.items():
        v = sorted(x for key, x in rows if key == k and x is not None)
        n = len(v)
        assert (r["n"], r["least"], r["q"], r["_low"], r["_high"], r["p99"], r["most"]) == (n, v[0], v[int(0.3 * n)], v[(n - 1) // 2], v[n // 2], v[int(0.99 * n)], v[-1])


def test_length_stats(spark):
    rows = [("a", v) for v in range(1, 101)] + [("b", 7), (None, 9)]
    got = {r["k"]: r for r in progress.length_stats(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", 50).collect()}
    assert (got["a"]["n"], got["a"]["least"], got["a"]["median"], got["a"]["most"], got["a"]["over_rate"], got["a"]["p95"]) == (100, 1, 50.5, 100, 0.5, 96)
    assert got["b"]["median"] == got["b"]["p95"] == 7 and got[None]["n"] == 1


def test_customer_rank_agreement_rounds_halves_as_its_sql_does(spark, tmp_path):
    from criterium.plans.catalog import ORACLE_SQL, QUERIES

    from tests.test_queries import matches

    rows = [(1, 2.5), (2, 2.0), (2, 1.0), (3, 3.5), (3, 3.5), (3, 0.1), (4, 4.0), (None, 9.0), (None, 1.0)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").toPandas().astype({"o_custkey": "Int64"}).to_parquet(tmp_path / "orders.parquet")
    matches(spark, str(tmp_path), QUERIES["customer_rank_agreement"], ORACLE_SQL["customer_rank_agreement"])
