"""Reconciling joins on nulls, repeats and differing texts."""

import random

from pyspark.sql import functions as F

from criterium.functions import verifiers
from criterium.operators import reconcile


def test_statuses(spark):
    left = spark.createDataFrame([(1, None, "x"), (2, 1, "x"), (3, 1, None), (4, 1, "a"), (4, 1, "b"), (5, 1, "x"), (7, 7, "x"), (7, 7, None)], "a int, b int, v string")
    right = spark.createDataFrame([(1, None, "x"), (2, 1, "y"), (3, 1, None), (4, 1, "a"), (6, 1, "x"), (7, 7, "x")], "a int, b int, v string")
    rows = reconcile.reconciled(left, right, ["a", "b"], "v")
    found = {r["a"]: (r["status"], r["n_left"], r["n_right"]) for r in rows.collect()}
    assert found == {1: ("equal", 1, 1), 2: ("unequal", 1, 1), 3: ("equal", 1, 1), 4: ("unequal", 2, 1), 5: ("left_only", 1, 0), 6: ("right_only", 0, 1), 7: ("unequal", 2, 1)}
    assert reconcile.totals(rows).first().asDict() == {"equal": 2, "unequal": 3, "left_only": 1, "right_only": 1, "repeated": 2}
    assert reconcile.reconciled(left.limit(0), right.limit(0), ["a", "b"], "v").count() == 0


def test_hot_keys_do_not_multiply(spark):
    left = spark.range(5000).select(F.lit(None).cast("int").alias("k"), F.lit("x").alias("v"))
    row = reconcile.reconciled(left, left, ["k"], "v").collect()
    assert [(r["n_left"], r["n_right"], r["status"]) for r in row] == [(5000, 5000, "equal")]


def test_first_difference(spark):
    draw = random.Random(1)
    pairs = [("abc", "abd"), ("", "a"), ("a", "a"), (None, "a"), ("ab", "abc"), ("é\U0001f600x", "é\U0001f600y"), ("x" * 70_000 + "a", "x" * 70_000 + "b")]
    pairs += [("".join(draw.choice("ab") for _ in range(draw.randrange(9))), "".join(draw.choice("ab") for _ in range(draw.randrange(9)))) for _ in range(200)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", reconcile.first_difference(F.col("a"), F.col("b")).alias("at")).collect()

    def plain(a, b):
        return None if a is None or b is None or a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert {r["i"]: r["at"] for r in got} == {i: plain(*p) for i, p in enumerate(pairs)}


def test_flags_keep_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, None), ("b", 1), ("b", 1)], "x string, y int")
    others = spark.createDataFrame([("a", None), (None, None), (None, None), ("b", 2)], "x string, y int")
    assert sorted((str(r["x"]), str(r["y"]), r["f"]) for r in reconcile.flagged(rows, others, ["x", "y"], "f").collect()) == [("None", "None", True), ("a", "1", False), ("a", "None", True), ("b", "1", False), ("b", "1", False)]


def test_defaults_and_denominators(spark):
    rows, tags = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1, None, True)], "k int, name string, ok boolean")
    found = reconcile.with_defaults(rows, tags, ["k"], {"name": "judge", "ok": False})
    assert sorted((r["k"], r["name"], r["ok"]) for r in found.collect()) == [(1, None, True), (2, "judge", False), (2, "judge", False)]
    labels = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c"), (4, "d")], "k int, cause string")
    local = spark.createDataFrame([(1, False), (2, True), (9, False), (4, None)], "k int, passed boolean")
    assert {r["cause"]: (r["n"], r["passes"], r["dropped"]) for r in reconcile.denominators(labels, local, ["k"]).collect()} == {"c": (1, 1, 1), "d": (0, 0, 0)}


def test_binary_reward(spark):
    texts = ["<think>a,</think>b", "<think>a</think>b,", "b", "</think>b", None, "<think>"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", verifiers.binary_reward(F.col("t"), [{"type": "no_commas"}]).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_default_tags_reads_the_lines_once(spark, data, tmp_path):
    import duckdb

    from criterium.plans.catalog import ORACLE_SQL, QUERIES

    from tests.test_queries import matches

    line = f"SELECT * FROM '{data}/lineitem.parquet'"
    duckdb.execute(f"COPY (FROM ({line}) UNION ALL SELECT * REPLACE (NULL::BIGINT AS l_orderkey) FROM ({line} WHERE l_tax <= 0.04 LIMIT 9)) TO '{tmp_path}/lineitem.parquet'")
    matches(spark, str(tmp_path), QUERIES["default_tags"], ORACLE_SQL["default_tags"])
    plan = QUERIES["default_tags"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
