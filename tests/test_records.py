"""Validation pools against two plain joins."""

from criterium.operators import records as R


def test_pool_equals_two_joins(spark):
    """Several models a prompt, answers that lack or are repeated, nulls."""
    votes = spark.createDataFrame([(p, c, m, j, "PASS", r) for p in (1, 2, 3, 4) for c in (0, 1, 3) for m in ("x", "y", None) for j, r in (("a", ""), ("b", None), ("c", "judge_refusal: no"))],
                                  "prompt_id long, criterion_index long, model string, judge string, verdict string, reason string")
    prompts = spark.createDataFrame([(1, 3), (2, 1), (4, 3)], "prompt_id long, n_criteria int")
    responses = spark.createDataFrame([(1, "x", "long text"), (1, "y", None), (1, None, "z"), (2, "x", "one"), (2, "x", "two"), (3, "x", "t")], "prompt_id long, model string, response string")
    votes.createOrReplaceTempView("v"), prompts.createOrReplaceTempView("p"), responses.createOrReplaceTempView("r")
    want = spark.sql("""SELECT v.prompt_id, v.model, criterion_index, judge, verdict, reason, n_criteria, left(response, 4) AS response_excerpt
        FROM v JOIN p ON v.prompt_id = p.prompt_id LEFT JOIN r ON v.prompt_id = r.prompt_id AND v.model = r.model
        WHERE criterion_index BETWEEN 1 AND n_criteria AND NOT coalesce(startswith(reason, 'judge_refusal'), false)""")
    got = R.validation_pool(votes, prompts, responses, 4)
    assert set(got.columns) == set(want.columns) and got.count() == 32
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_validation_pool_deals_the_votes_once(spark, data):
    """The lines are dealt by prompt; neither votes nor their joins are dealt or sorted again."""
    from criterium.plans.catalog import QUERIES

    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("false", "-1")):
            spark.conf.set(k, v)
        plan = QUERIES["validation_pool"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("l_orderkey" in x for x in dealt) == 1 and not any("l_linenumber" in x or "model" in x for x in dealt)
