"""Queries over panel votes: consensus, agreement, pass rates, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.functions import stats
from criterium.operators import failures, normalise, summary, votes
from criterium.plans.catalog import query
from criterium.plans.derive import JUDGES, table

VOTE = """CASE WHEN starts_with(reason, 'judge_refusal') OR starts_with(reason, 'judge_parse_error') OR starts_with(reason, 'judge_truncated') OR starts_with(reason, 'missing_in_judge_output')
  THEN 'ABSTAIN' WHEN verdict = 'PASS' THEN 'PASS' ELSE 'FAIL' END"""
CAST = f"SELECT *, {VOTE} AS vote FROM {{votes}}"
SPLIT = f"""SELECT prompt_id, criterion_index, model, CAST(count(*) FILTER (WHERE vote = 'PASS') AS BIGINT) AS n_pass, CAST(count(*) FILTER (WHERE vote = 'FAIL') AS BIGINT) AS n_fail,
  max(vote) FILTER (WHERE judge = 'a' AND vote <> 'ABSTAIN') AS av, max(reason) FILTER (WHERE judge = 'a') AS ar FROM ({CAST}) AS v GROUP BY ALL"""
COMMON = f"""SELECT prompt_id, criterion_index, model, arg_min(reason, -n * 10 + first) AS common FROM
  (SELECT prompt_id, criterion_index, model, reason, count(*) AS n, min(judge_ord) AS first FROM ({CAST}) AS v WHERE vote = 'FAIL' GROUP BY ALL) AS r GROUP BY ALL"""
BOTH = f"SELECT s.*, 3 - n_pass - n_fail AS n_abstain, common FROM ({SPLIT}) AS s LEFT JOIN ({COMMON}) AS c USING (prompt_id, criterion_index, model)"
MAJORITY = f"""SELECT prompt_id, criterion_index, model, CASE WHEN n_pass + n_fail >= 2 AND n_pass > n_fail THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN n_pass + n_fail < 2 THEN 'panel_no_quorum' WHEN n_pass = n_fail THEN 'panel_tie' WHEN n_pass > n_fail THEN '' ELSE common END AS reason, n_pass, n_fail, n_abstain FROM ({BOTH}) AS b"""
ANCHORED = f"""SELECT prompt_id, criterion_index, model,
  CASE WHEN n_pass + n_fail < 2 THEN 'EXCLUDE' WHEN n_pass = n_fail THEN coalesce(av, 'EXCLUDE') WHEN n_pass > n_fail THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN n_pass + n_fail < 2 THEN 'panel_incomplete' WHEN n_pass = n_fail THEN CASE WHEN av IS NULL THEN 'panel_undecidable' WHEN av = 'PASS' THEN '' WHEN ar = '' THEN 'panel_tiebreak_fail' ELSE ar END
    WHEN n_pass > n_fail THEN '' ELSE common END AS reason, n_pass, n_fail, n_abstain, n_pass + n_fail >= 2 AND n_pass = n_fail AND av IS NOT NULL AS tiebreak FROM ({BOTH}) AS b"""


def panel_votes(spark, d):
    return table(spark, d, "votes")


def majority(spark, d):
    return votes.consensus(panel_votes(spark, d), len(JUDGES))


def anchored(spark, d):
    return votes.consensus(panel_votes(spark, d), len(JUDGES), "a")


@query(f"SELECT judge, vote, CAST(count(*) AS BIGINT) AS n FROM ({CAST}) AS v GROUP BY ALL")
def vote_mapping(spark, d):
    return votes.with_vote(panel_votes(spark, d)).groupBy("judge", "vote").agg(F.count(F.lit(1)).alias("n"))


@query(MAJORITY)
def consensus_majority(spark, d):
    return majority(spark, d)


@query(ANCHORED)
def consensus_anchored(spark, d):
    return anchored(spark, d)


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n_cells, CAST(count(*) FILTER (WHERE n_pass + n_fail < 2) AS BIGINT) AS n_incomplete, count(*) FILTER (WHERE n_pass + n_fail < 2) = 0 AS complete FROM ({SPLIT}) AS s""")
def completeness(spark, d):
    return votes.completeness(panel_votes(spark, d), JUDGES)


@query(f"""SELECT prompt_id, criterion_index, model, CAST(count(*) FILTER (WHERE vote <> 'ABSTAIN') AS BIGINT) AS n_valid,
  concat_ws(',', CASE WHEN count(*) FILTER (WHERE judge = 'a' AND vote <> 'ABSTAIN') = 0 THEN 'a' END, CASE WHEN count(*) FILTER (WHERE judge = 'b' AND vote <> 'ABSTAIN') = 0 THEN 'b' END,
    CASE WHEN count(*) FILTER (WHERE judge = 'c' AND vote <> 'ABSTAIN') = 0 THEN 'c' END) AS abstaining FROM ({CAST}) AS v GROUP BY prompt_id, criterion_index, model HAVING count(*) FILTER (WHERE vote <> 'ABSTAIN') < 2""")
def incomplete_cells(spark, d):
    return votes.incomplete_cells(panel_votes(spark, d), JUDGES).withColumn("abstaining", F.array_join("abstaining", ","))


@query(f"""SELECT x.judge AS judge_a, y.judge AS judge_b, CAST(count(*) AS BIGINT) AS n, round_even(100.0::DOUBLE * count(*) FILTER (WHERE x.vote = y.vote) / count(*), 2) AS agreement
FROM ({CAST}) AS x JOIN ({CAST}) AS y USING (prompt_id, criterion_index, model) WHERE x.judge <> y.judge AND x.vote <> 'ABSTAIN' AND y.vote <> 'ABSTAIN' GROUP BY ALL""")
def pairwise_agreement(spark, d):
    return votes.pairwise_agreement(panel_votes(spark, d), JUDGES)


@query(f"""SELECT j.judge, CAST((SELECT count(*) FROM ({SPLIT}) AS s) - count(v.vote) AS BIGINT) AS abstentions FROM (VALUES ('a'), ('b'), ('c')) AS j(judge)
LEFT JOIN (SELECT * FROM ({CAST}) AS x WHERE vote <> 'ABSTAIN') AS v ON v.judge = j.judge GROUP BY j.judge""")
def abstentions(spark, d):
    return votes.abstentions(panel_votes(spark, d), JUDGES)


@query(f"""SELECT CAST(count(*) AS BIGINT) AS cells, round_even((avg((n_pass * (n_pass - 1) + n_fail * (n_fail - 1)) / ((n_pass + n_fail) * (n_pass + n_fail - 1))::DOUBLE) - any_value(pe)) / (1 - any_value(pe)), 4) AS kappa
FROM ({SPLIT}) AS s CROSS JOIN (SELECT pow(sum(n_pass) / sum(n_pass + n_fail)::DOUBLE, 2) + pow(sum(n_fail) / sum(n_pass + n_fail)::DOUBLE, 2) AS pe FROM ({SPLIT}) AS z WHERE n_pass + n_fail >= 2) AS p WHERE n_pass + n_fail >= 2""")
def fleiss_kappa(spark, d):
    return votes.fleiss_kappa(panel_votes(spark, d))


@query(f"""SELECT judge, CAST(count(*) AS BIGINT) AS n, round_even(100.0::DOUBLE * count(*) FILTER (WHERE v.vote = CASE WHEN n_pass > n_fail THEN 'PASS' ELSE 'FAIL' END) / count(*), 2) AS agreement
FROM ({CAST}) AS v JOIN ({SPLIT}) AS s USING (prompt_id, criterion_index, model) WHERE vote <> 'ABSTAIN' AND n_pass + n_fail >= 2 AND n_pass <> n_fail GROUP BY judge""")
def agreement_with_consensus(spark, d):
    return votes.agreement_with_consensus(panel_votes(spark, d), JUDGES)


@query("""SELECT judge, split_part(reason, ':', 1) AS artifact, CAST(count(*) AS BIGINT) AS n FROM {votes}
WHERE starts_with(reason, 'judge_refusal') OR starts_with(reason, 'judge_truncated') OR starts_with(reason, 'missing_in') GROUP BY ALL""")
def artifact_counts(spark, d):
    return votes.artifact_counts(panel_votes(spark, d))


SCORED = f"SELECT * FROM ({ANCHORED}) AS x WHERE verdict <> 'EXCLUDE'"
RATE = "CAST(count(*) FILTER (WHERE verdict = 'PASS') AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS scored, round_even(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'PASS') / count(*), 2) AS pass_rate"


@query(f"SELECT model, {RATE} FROM ({SCORED}) AS s GROUP BY model")
def pass_rate(spark, d):
    return summary.pass_rate(anchored(spark, d), ["model"])


PROMPT = f"""SELECT prompt_id, model, CAST(count(*) FILTER (WHERE verdict = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE verdict <> 'EXCLUDE') AS BIGINT) AS scored FROM ({ANCHORED}) AS x GROUP BY ALL"""


@query(f"SELECT *, concat(passed, '/', scored) AS criteria_passed, scored > 0 AND passed = scored AS full_pass FROM ({PROMPT}) AS p")
def criteria_passed(spark, d):
    return summary.per_prompt(anchored(spark, d))


@query(f"""SELECT model, CAST(count(*) FILTER (WHERE scored > 0 AND passed = scored) AS BIGINT) AS "full", CAST(count(*) AS BIGINT) AS prompts,
  round_even(100.0::DOUBLE * count(*) FILTER (WHERE scored > 0 AND passed = scored) / count(*), 2) AS rate FROM ({PROMPT}) AS p GROUP BY model""")
def full_prompt_rate(spark, d):
    return summary.full_prompt_rate(anchored(spark, d))


@query(f"""SELECT model, dimension, value, {RATE} FROM (SELECT s.*, 'all' AS dimension, '' AS value FROM ({SCORED}) AS s WHERE prompt_id IN (SELECT prompt_id FROM {{prompts}})
  UNION ALL SELECT s.*, 'instruction_type', instruction_type FROM ({SCORED}) AS s JOIN {{prompts}} AS p USING (prompt_id)
  UNION ALL SELECT s.*, 'prompt_style', prompt_style FROM ({SCORED}) AS s JOIN {{prompts}} AS p USING (prompt_id)
  UNION ALL SELECT s.*, 'use_case', use_case FROM ({SCORED}) AS s JOIN {{prompts}} AS p USING (prompt_id)) AS u GROUP BY ALL""")
def summary_grouping_sets(spark, d):
    return summary.breakdown(anchored(spark, d), table(spark, d, "prompts"), ["instruction_type", "prompt_style", "use_case"])


@query(f"SELECT model, reason, CAST(count(*) AS BIGINT) AS n FROM ({ANCHORED}) AS x WHERE verdict = 'EXCLUDE' GROUP BY ALL")
def exclusions(spark, d):
    return summary.exclusions(anchored(spark, d))


@query("""SELECT count(DISTINCT prompt_id) AS n_prompts, count(DISTINCT (prompt_id, criterion_index)) AS n_criteria, count(DISTINCT model) AS n_models, count(DISTINCT judge) AS n_judges,
  count(DISTINCT (prompt_id, model, judge)) AS n_grade_cells FROM {votes}""")
def counts_block(spark, d):
    return summary.counts(panel_votes(spark, d))


@query("""SELECT 'instruction_type' AS "column", instruction_type AS value, count(*) AS n FROM {prompts} GROUP BY ALL UNION ALL SELECT 'prompt_style', prompt_style, count(*) FROM {prompts} GROUP BY ALL
UNION ALL SELECT 'use_case', use_case, count(*) FROM {prompts} GROUP BY ALL""")
def categories_block(spark, d):
    return summary.value_counts(table(spark, d, "prompts"), ["instruction_type", "prompt_style", "use_case"])


@query("""WITH p AS (SELECT o_orderkey AS prompt_id, o_orderpriority FROM orders), g AS (SELECT prompt_id, count(DISTINCT (model, judge)) AS grades, count(DISTINCT model) AS responses FROM {votes} GROUP BY 1),
m AS (SELECT p.prompt_id, concat_ws(',', CASE WHEN o_orderpriority LIKE '5%' THEN 'tags' END, CASE WHEN coalesce(responses, 0) < 1 THEN 'responses' END, CASE WHEN coalesce(grades, 0) < 3 THEN 'grades' END) AS missing
  FROM p LEFT JOIN g USING (prompt_id)) SELECT prompt_id, missing = '' AS eligible, missing FROM m""")
def eligibility_division(spark, d):
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), "o_orderpriority")
    grades = panel_votes(spark, d)
    return summary.eligible_prompts(prompts, prompts.where("o_orderpriority not like '5%'"), grades, grades, 1, len(JUDGES))


@query("""SELECT c.prompt_id, c.criterion_index, m.model, coalesce(v.verdict, 'FAIL') AS verdict, CASE WHEN v.verdict IS NULL THEN 'missing_verdict' ELSE v.reason END AS reason
FROM (SELECT DISTINCT prompt_id, criterion_index FROM {cell}) AS c CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) AS m(model) LEFT JOIN (SELECT * FROM {votes} WHERE judge = 'c') AS v USING (prompt_id, criterion_index, model)""")
def single_judge_view(spark, d):
    criteria = table(spark, d, "cell").select("prompt_id", "criterion_index").distinct()
    own = panel_votes(spark, d).where("judge = 'c'").select(*votes.CELL, "verdict", "reason")
    return summary.single_judge_view(criteria, spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string"), own)


@query("SELECT count(*) AS n, round_even(100.0::DOUBLE * avg((quality = toxic)::INT), 2) AS agreement, round_even((avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 4) AS kappa FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def cohens_kappa(spark, d):
    return stats.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def confusion_matrix(spark, d):
    return failures.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agree, round_even(100.0::DOUBLE * count(*) FILTER (WHERE quality = toxic) / count(*), 2) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY source")
def judge_vs_human(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return failures.agreement_by(rows, "source", "quality", "toxic")


@query("""SELECT f.prompt_id, f.criterion_index, f.model, f.root_cause, coalesce(n_pass, 0) AS n_pass, coalesce(n_fail, 0) AS n_fail, coalesce(n_abstain, 0) AS n_abstain, coalesce(n_fail >= 2 AND n_pass = 0, false) AS concur
FROM {failures} AS f LEFT JOIN (SELECT prompt_id, criterion_index, model, count(*) FILTER (WHERE vote = 'PASS') AS n_pass, count(*) FILTER (WHERE vote = 'FAIL') AS n_fail, count(*) FILTER (WHERE vote = 'ABSTAIN') AS n_abstain
  FROM (""" + CAST + """) AS v GROUP BY ALL) AS s USING (prompt_id, criterion_index, model)""")
def concurrence(spark, d):
    rows = votes.concurrence(table(spark, d, "failures").select(*votes.CELL, "root_cause"), panel_votes(spark, d))
    return rows.withColumn("concur", votes.all_concur_fail(F.lit(None).cast("string"), F.col("n_pass"), F.col("n_fail")))


@query("""SELECT root_cause, 'all' AS dimension, '' AS value, count(*) AS n FROM {failures} GROUP BY ALL UNION ALL SELECT root_cause, 'model', model, count(*) FROM {failures} GROUP BY ALL
UNION ALL SELECT root_cause, 'criterion_index', CAST(criterion_index AS STRING), count(*) FROM {failures} GROUP BY ALL""")
def root_cause_rollup(spark, d):
    return failures.rollup(table(spark, d, "failures"), ["model", "criterion_index"])


SHARES = """SELECT root_cause, n, round_even(100.0::DOUBLE * n / sum(n) OVER (), 2) AS share, round_even(100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, root_cause) / sum(n) OVER (), 2) AS running,
  row_number() OVER (ORDER BY n DESC, root_cause) AS rank FROM (SELECT root_cause, count(*) AS n FROM {failures} GROUP BY 1) AS g"""


@query(SHARES)
def pareto_share(spark, d):
    return failures.shares(table(spark, d, "failures"))


@query(f"SELECT string_agg(root_cause, ',' ORDER BY root_cause) AS top FROM ({SHARES}) AS s WHERE rank <= 3")
def top3(spark, d):
    return failures.top_causes(table(spark, d, "failures"), 3)


@query("""WITH t AS (SELECT model = 'm0' AS own, root_cause, row_number() OVER (PARTITION BY model = 'm0' ORDER BY count(*) DESC, root_cause) AS r FROM {failures} GROUP BY 1, 2)
SELECT string_agg(root_cause, ',' ORDER BY root_cause) FILTER (WHERE own) AS top_a, string_agg(root_cause, ',' ORDER BY root_cause) FILTER (WHERE NOT own) AS top_b,
  string_agg(root_cause, ',' ORDER BY root_cause) FILTER (WHERE own) = string_agg(root_cause, ',' ORDER BY root_cause) FILTER (WHERE NOT own) AS holds FROM t WHERE r <= 3""")
def top3_set_holds(spark, d):
    rows = table(spark, d, "failures")
    return failures.same_top(rows.where("model = 'm0'"), rows.where("model <> 'm0'"), 3)


@query("SELECT CAST(max(coalesce(taxonomy_version, 1)) AS BIGINT) AS version, CASE WHEN count(DISTINCT coalesce(taxonomy_version, 1)) > 1 THEN array_to_string(list_sort(list(DISTINCT coalesce(taxonomy_version, 1))), ',') END AS mixed FROM {failures}")
def taxonomy_provenance(spark, d):
    return failures.provenance(table(spark, d, "failures"))


@query("SELECT prompt_id, model, count(*) AS n FROM {votes} WHERE starts_with(reason, 'judge_refusal') GROUP BY ALL")
def refusal_census(spark, d):
    return failures.refusal_census(panel_votes(spark, d))


@query("SELECT prompt_id, criterion_index, count(*) AS n FROM {failures} WHERE root_cause = 'R-F' GROUP BY ALL")
def cause_concentration(spark, d):
    return failures.concentration(table(spark, d, "failures"), "R-F")


@query(f"""SELECT model, prompt_id, array_to_string(list_sort(list(criterion_index)), ',') AS failed FROM ({MAJORITY}) AS x WHERE verdict = 'FAIL' AND reason NOT IN ('panel_no_quorum', 'panel_tie')
AND prompt_id NOT IN (SELECT prompt_id FROM {{cell}} WHERE q < 3) GROUP BY ALL""")
def failed_cell_targets(spark, d):
    failed = votes.failed_by_majority(panel_votes(spark, d), len(JUDGES))
    return failures.without_diagnosis(failed, table(spark, d, "cell").where("q < 3")).withColumn("failed", F.array_join(F.col("failed").cast("array<string>"), ","))


@query("""SELECT p.prompt_id, s.index, CASE WHEN upper(trim(v.verdict)) = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN v.verdict IS NULL THEN 'missing_in_judge_output' ELSE coalesce(v.reason, '') END AS reason
FROM (SELECT DISTINCT prompt_id FROM {cell}) AS p CROSS JOIN (SELECT unnest(range(1, 9)) AS index) AS s
LEFT JOIN (SELECT prompt_id, criterion_index, arg_max(verdict, judge_ord) AS verdict, arg_max(reason, judge_ord) AS reason FROM {votes} GROUP BY ALL) AS v ON v.prompt_id = p.prompt_id AND v.criterion_index = s.index""")
def verdict_normalisation(spark, d):
    parsed = panel_votes(spark, d).select("prompt_id", F.col("judge_ord").alias("ord"), F.col("criterion_index").cast("string").alias("index"), "verdict", "reason")
    prompts = table(spark, d, "cell").select("prompt_id").distinct().withColumn("n", F.lit(8))
    return normalise.verdicts(parsed, prompts, ["prompt_id"])


@query("""SELECT p.prompt_id, s.index, CASE WHEN c.ls = 'F' THEN 'auto' ELSE 'judge' END AS verifiability, coalesce(c.q > 25, false) AS gameable, CASE WHEN c.q > 25 THEN c.rf ELSE '' END AS reward_hack, coalesce(c.d > 0.05, false) AS ambiguous
FROM (SELECT DISTINCT prompt_id FROM {cell}) AS p CROSS JOIN (SELECT unnest(range(1, 9)) AS index) AS s LEFT JOIN {cell} AS c ON c.prompt_id = p.prompt_id AND c.criterion_index = s.index""")
def tag_normalisation(spark, d):
    cell = table(spark, d, "cell")
    parsed = cell.select(
        "prompt_id", F.lit(0).alias("ord"), F.col("criterion_index").cast("string").alias("index"), F.when(F.col("ls") == "F", "auto").otherwise("human").alias("verifiability"),
        (F.col("q") > 25).alias("gameable"), F.col("rf").alias("reward_hack"), (F.col("d") > 0.05).alias("ambiguous"),
    )
    return normalise.tags(parsed, cell.select("prompt_id").distinct().withColumn("n", F.lit(8)), ["prompt_id"])


@query("""SELECT prompt_id, min(CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN bad THEN 'unknown_cause' END) AS error FROM
(SELECT c.prompt_id, c.criterion_index, g.n, g.bad FROM {cell} AS c LEFT JOIN (SELECT prompt_id, criterion_index, count(*) AS n, bool_or(root_cause NOT IN ('N-O', 'R-F')) AS bad FROM {failures} GROUP BY ALL) AS g USING (prompt_id, criterion_index)) AS x GROUP BY prompt_id""")
def diagnosis_errors(spark, d):
    rows = table(spark, d, "failures").withColumnRenamed("criterion_index", "index")
    return normalise.diagnosis_errors(rows, table(spark, d, "cell").withColumnRenamed("criterion_index", "index"), ["N-O", "R-F"], ["prompt_id"])


@query("""SELECT prompt_id, criterion_index, arg_min(reason, judge_ord) FILTER (WHERE verdict = 'PASS') AS result, count(*) AS attempts FROM {votes} GROUP BY ALL""")
def chain_resolution(spark, d):
    rows = panel_votes(spark, d).select("prompt_id", "criterion_index", F.col("judge_ord").alias("member_ord"), F.lit(0).alias("attempt"), (F.col("verdict") == "PASS").alias("ok"), F.col("reason").alias("result"))
    return normalise.resolve_chain(rows, ["prompt_id", "criterion_index"])


@query("""SELECT l_orderkey, arg_min(l_partkey, l_suppkey * 1000 + l_linenumber) FILTER (WHERE l_quantity >= 30) AS answer, min(l_suppkey * 1000 + l_linenumber) FILTER (WHERE l_quantity >= 30) AS accepted_at, count(*) AS attempts, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens
FROM (SELECT l_orderkey, l_suppkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) AS x GROUP BY l_orderkey""")
def rejection_sampling(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_linenumber").agg(F.min("l_partkey").alias("answer"), F.min("l_quantity").alias("q"))
    rows = rows.select("l_orderkey", (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("attempt"), (F.col("q") >= 30).alias("passed"), "answer", F.col("q").cast("long").alias("tokens"))
    return normalise.first_accepted(rows, ["l_orderkey"])
