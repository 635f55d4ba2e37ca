"""Queries over records around the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.operators import records as R
from criterium.plans.catalog import query
from criterium.plans.derive import table
from criterium.streaming import budget


def prompts(spark, d):
    return table(spark, d, "prompts")


@query("""SELECT v.judge, v.verdict, count(*) AS n, CAST(sum(length(left(p.use_case, 4))) AS BIGINT) AS chars FROM {votes} AS v JOIN {prompts} AS p USING (prompt_id)
WHERE criterion_index BETWEEN 1 AND 5 AND NOT (starts_with(reason, 'judge_parse_error') OR starts_with(reason, 'judge_truncated') OR starts_with(reason, 'judge_refusal')) GROUP BY ALL""")
def validation_pool(spark, d):
    p = prompts(spark, d)
    answers = p.select("prompt_id", F.concat(F.lit("m"), (F.col("prompt_id") % 3).cast("string")).alias("model"), F.col("use_case").alias("response"))
    votes = table(spark, d, "votes", {"lineitem": "l_orderkey"})
    rows = R.validation_pool(votes, p.withColumn("n_criteria", F.lit(5)), answers, 4)
    return rows.groupBy("judge", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("response_excerpt")).alias("chars"))


HUMAN = "SELECT prompt_id, verdict, CASE WHEN prompt_id % 4 = 0 THEN ' pass' WHEN prompt_id % 4 = 1 THEN 'FAIL' WHEN prompt_id % 4 = 2 THEN '' END AS human FROM {votes} WHERE judge = 'a'"


def human(spark, d):
    mark = F.when(F.col("prompt_id") % 4 == 0, " pass").when(F.col("prompt_id") % 4 == 1, "FAIL").when(F.col("prompt_id") % 4 == 2, "")
    return table(spark, d, "votes").where("judge = 'a'").select("prompt_id", "verdict", mark.alias("human"))


@query(f"""SELECT 'scored' AS status, count(*) AS n, count(*) FILTER (WHERE upper(trim(human)) IN ('PASS', 'FAIL')) AS labelled, round_even(100.0::DOUBLE * count(*) FILTER (WHERE upper(trim(human)) = verdict) / count(*) FILTER (WHERE upper(trim(human)) IN ('PASS', 'FAIL')), 2) AS agreement FROM ({HUMAN}) AS h""")
def validation_status(spark, d):
    return R.validation_status(human(spark, d), "verdict", "human")


@query(f"SELECT prompt_id, verdict, upper(trim(human)) AS human, count(*) AS n FROM ({HUMAN}) AS h WHERE upper(trim(human)) IN ('PASS', 'FAIL') GROUP BY ALL")
def human_filled(spark, d):
    return R.human_filled(human(spark, d)).groupBy("prompt_id", "verdict", "human").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) FILTER (WHERE h IN ('PASS', 'FAIL')) AS labelled, count(*) FILTER (WHERE coalesce(h NOT IN ('PASS', 'FAIL'), true)) AS unlabelled, count(*) FILTER (WHERE h IN ('PASS', 'FAIL') AND h = verdict) AS agree,
  count(*) FILTER (WHERE h IN ('PASS', 'FAIL') AND h <> verdict) AS disagree FROM (SELECT verdict, upper(trim(human)) AS h FROM ({HUMAN}) AS x) AS y""")
def label_stats(spark, d):
    return R.label_stats(human(spark, d).withColumn("human", F.upper(F.trim("human"))), "verdict", "human")


@query("""SELECT coalesce(g.root_cause, e.root_cause) AS root_cause, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM (SELECT root_cause, count(*) AS n FROM {failures} GROUP BY 1) AS g
FULL JOIN (VALUES ('A-F', 10::BIGINT), ('X', 0::BIGINT)) AS e(root_cause, expected) ON g.root_cause = e.root_cause""")
def pool_size_guard(spark, d):
    return R.size_guard(table(spark, d, "failures"), "root_cause", {"A-F": 10, "X": 0})


@query("""SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS extra, count(d.doc_id) AS ours, count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS same
FROM (SELECT DISTINCT doc_id FROM documents) AS d FULL JOIN (SELECT DISTINCT doc_id FROM labels) AS l ON l.doc_id = d.doc_id""")
def row_set_check(spark, d):
    return R.row_sets(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("""SELECT lang AS cause, accepted, count(*) AS n, round(avg(n_chars), 6) AS mean FROM (SELECT *, doc_id % 3 = 0 AS accepted FROM documents) AS x GROUP BY ALL UNION ALL SELECT lang, NULL, count(*), round(avg(n_chars), 6) FROM documents GROUP BY lang""")
def difficulty_grouping_sets(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("cause"), (F.col("doc_id") % 3 == 0).alias("accepted"), "n_chars")
    return R.difficulty(rows, "n_chars")


@query("""SELECT label, count(*) AS n, round(avg((list_position(e, list_max(e)) - 1 = label % 4)::INT), 6) AS accuracy FROM (SELECT label, embedding[1:4] AS e FROM embeddings) AS x GROUP BY label""")
def choice_accuracy(spark, d):
    rows = table(spark, d, "embeddings").select("label", R.first_largest(F.slice("embedding", 1, 4)).alias("pred"), (F.col("label") % 4).cast("long").alias("gold"))
    return R.accuracy(rows, ["label"], "pred", "gold")


@query("SELECT count(*) AS n, round(sum(coalesce(CASE WHEN event_type <> 'view' THEN value END, 0)) / count(*), 6) AS mean FROM events")
def native_score_mean(spark, d):
    return R.mean_score(table(spark, d, "events").withColumn("s", F.when(F.col("event_type") != "view", F.col("value"))), "s")


@query("SELECT c_custkey, CASE WHEN kind LIKE '%conflict%' THEN 'conflict' ELSE 'aligned' END AS track FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'rule_conflict' WHEN 1 THEN 'aligned_rule' ELSE 'other' END AS kind FROM customer WHERE c_nationkey > 3) AS x WHERE kind <> 'other'")
def trainable_rows(spark, d):
    kind = F.when(F.col("c_custkey") % 4 == 0, "rule_conflict").when(F.col("c_custkey") % 4 == 1, "aligned_rule").otherwise("other")
    rows = table(spark, d, "customer").select("c_custkey", kind.alias("kind"), F.when(F.col("c_nationkey") > 3, "f").alias("func"))
    return R.trainable(rows, "kind", "func").select("c_custkey", "track")


@query("SELECT count(*) FILTER (WHERE n_chars <= 2000) AS kept, count(*) FILTER (WHERE n_chars > 2000) AS too_long FROM documents")
def length_filter(spark, d):
    return R.within_length(table(spark, d, "documents"), "n_chars", 2000)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'E' WHEN n_nationkey % 3 = 1 THEN 'T' END AS track, CASE WHEN n_nationkey % 3 < 2 THEN 10 + n_nationkey END AS number, CASE WHEN n_nationkey % 3 < 2 THEN lower(n_name) END AS label FROM nation")
def slug_parse(spark, d):
    k = F.col("n_nationkey")
    slug = F.concat(F.when(k % 3 == 0, "E").when(k % 3 == 1, "T").otherwise("X"), (k + 10).cast("string"), F.lit("-"), F.lower("n_name"))
    return table(spark, d, "nation").select("n_nationkey", R.slug_parts(slug).alias("s")).select("n_nationkey", "s.*")


@query("SELECT concat('r', n_regionkey, '/', n_name) AS judge, concat('r', n_regionkey) AS family FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)")
def family_overlap(spark, d):
    judges = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name")).alias("judge"))
    candidates = table(spark, d, "region").where("r_regionkey > 2").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit("/x")).alias("model"))
    return R.family_overlap(judges, candidates)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(value AS DOUBLE) END AS x FROM events")
def numeric_values(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, " ").otherwise("n/a")
    return table(spark, d, "events").select("event_id", R.numbers_of(text).alias("x"))


@query("SELECT lang, count(*) FILTER (WHERE doc_id % 3 = 0) AS accepted, CAST(sum(doc_id % 4 + 1) AS BIGINT) AS attempts, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (WHERE doc_id % 3 = 0) / count(*), 2) AS yield FROM documents GROUP BY lang")
def teacher_yield(spark, d):
    rows = table(spark, d, "documents").select("lang", (F.col("doc_id") % 3 == 0).alias("accepted"), (F.col("doc_id") % 4 + 1).alias("attempts"), F.col("n_chars").alias("tokens"))
    return R.yields(rows, ["lang"])


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) AS completion FROM conversations GROUP BY conv_id")
def completion_text(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", R.completion_text(F.col("m")).alias("completion"))


@query("SELECT n_nationkey, n_name AS decoded, base64(encode(n_name)) AS encoded FROM nation")
def base64_round_trip(spark, d):
    encoded = F.base64(F.encode("n_name", "UTF-8"))
    return table(spark, d, "nation").select("n_nationkey", F.decode(F.unbase64(encoded), "UTF-8").alias("decoded"), encoded.alias("encoded"))


DAY = 86_400_000_000
BUDGET, STALL, EVERY = 12 * DAY, 2 * DAY, 8


@query(f"""WITH e AS (SELECT user_id AS run, epoch_us(ts) AS t, event_type AS c, event_id FROM events),
r AS (SELECT run, min(t) + {BUDGET} AS ends FROM e GROUP BY run), m AS (SELECT max(t) AS fin FROM e),
k AS (SELECT *, lag(c) OVER w IS DISTINCT FROM c AS moved FROM e WINDOW w AS (PARTITION BY run ORDER BY t, c)),
g AS (SELECT run, t, lead(t) OVER (PARTITION BY run ORDER BY t, c) AS nxt FROM k WHERE moved),
f AS (SELECT run, 'stall' AS kind, t + {STALL} AS at_us FROM g JOIN r USING (run), m WHERE t + {STALL} < ends AND t + {STALL} <= coalesce(nxt, fin)
UNION ALL SELECT run, 'budget', ends FROM r, m WHERE ends <= fin)
SELECT f.run, kind, at_us, count(*) AS step, count(*) // {EVERY} * {EVERY} AS resume_step FROM f JOIN e ON e.run = f.run AND e.t < f.at_us GROUP BY ALL""")
def run_budgets(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("counter"))
    return budget.in_slices(rows, 3, BUDGET, STALL, EVERY)
