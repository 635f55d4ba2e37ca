"""Queries over joins, tallies and selections besides the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.functions import stats, verifiers
from criterium.operators import estimands, failures, joined, loops, records, resample, sampling
from criterium.plans import texts
from criterium.plans.catalog import ORACLE_SQL, query
from criterium.plans.derive import table

SPECS = "SELECT prompt_id, instruction_type AS a, prompt_style AS b FROM {prompts}"


@query(f"""SELECT c.prompt_id, c.model, x.position, CASE x.position WHEN 0 THEN a ELSE b END AS spec
FROM (SELECT DISTINCT prompt_id, model FROM {{cell}}) AS c JOIN ({SPECS}) AS p USING (prompt_id) CROSS JOIN (VALUES (0), (1)) AS x(position)""")
def decodes_with_specs(spark, d):
    prompts = table(spark, d, "prompts").select("prompt_id", F.array("instruction_type", "prompt_style").alias("specs"))
    return joined.with_specs(table(spark, d, "cell").select("prompt_id", "model").distinct(), prompts, "prompt_id")


@query("""SELECT root_cause, count(*) FILTER (WHERE criterion_index <= 3) AS matched, count(*) FILTER (WHERE criterion_index > 3) AS unmatched
FROM {failures} GROUP BY root_cause""")
def failed_criterion_texts(spark, d):
    prompts = table(spark, d, "prompts").select("prompt_id", F.array("instruction_type", "prompt_style", "use_case").alias("criteria"))
    rows = joined.criterion_texts(table(spark, d, "failures"), prompts, "prompt_id")
    return joined.unmatched(rows, "root_cause", F.col("criterion").isNotNull())


@query("""SELECT f.model, count(*) AS n FROM {failures} AS f
JOIN (SELECT prompt_id, criterion_index FROM {cell} WHERE t <= 0.04) AS v USING (prompt_id, criterion_index) GROUP BY f.model""")
def verifiable_failures(spark, d):
    tags = table(spark, d, "cell").select("prompt_id", "criterion_index", (F.col("t") <= 0.04).alias("verifiable"))
    rows = table(spark, d, "failures").join(tags, ["prompt_id", "criterion_index"], "left").where("verifiable")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manifest_semi_join(spark, d):
    return texts.docs(spark, d).join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS accepted FROM documents")
def accepted_flag(spark, d):
    return joined.flagged_existence(texts.docs(spark, d).select("doc_id"), table(spark, d, "labels").where("quality = 1"), "doc_id", "accepted")


@query("""SELECT n_nationkey AS number, n_name AS name FROM nation WHERE n_nationkey < 17 AND n_regionkey > 1 ORDER BY n_nationkey DESC LIMIT 1""")
def nearest_lower(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"), (F.col("n_regionkey") > 1).alias("analysed"))
    return failures.predecessor(rows, 17).select("number", "name")


CUT = "prompt_id IN (SELECT prompt_id FROM {failures} WHERE root_cause = 'N-O')"


@query(f"""SELECT CASE WHEN {CUT} THEN 'shared' ELSE 'disjoint' END AS cut, model, count(*) AS n
FROM {{failures}} WHERE root_cause = 'A-F' GROUP BY ALL""")
def shared_and_disjoint(spark, d):
    rows = table(spark, d, "failures")
    found = joined.cuts(rows.where("root_cause = 'A-F'"), rows.where("root_cause = 'N-O'"), "prompt_id")
    return found.groupBy("cut", "model").agg(F.count(F.lit(1)).alias("n"))


DRAW = "md5('5:' || prompt_id)"


@query(f"""WITH h AS (SELECT DISTINCT prompt_id FROM (SELECT root_cause, prompt_id, row_number() OVER (PARTITION BY root_cause ORDER BY {DRAW}, prompt_id) AS place
  FROM (SELECT DISTINCT root_cause, prompt_id FROM {{failures}} WHERE root_cause IN ('A-F', 'N-O')) AS x) AS y WHERE place <= 20),
o AS (SELECT prompt_id, row_number() OVER (ORDER BY {DRAW}, prompt_id) AS place
  FROM (SELECT DISTINCT prompt_id FROM {{failures}} WHERE prompt_id NOT IN (SELECT prompt_id FROM h)) AS z)
SELECT prompt_id, false AS topped_up FROM h UNION ALL SELECT prompt_id, true FROM o WHERE place <= 40 - (SELECT count(*) FROM h)""")
def half_by_cause(spark, d):
    return sampling.half_each(table(spark, d, "failures"), "root_cause", "prompt_id", ("A-F", "N-O"), 40, 5)


@query("SELECT arm, cause, count(*) AS n, round(avg(passed::INT), 6) AS rate FROM {records} GROUP BY ALL")
def decode_pass_rates(spark, d):
    return estimands.decode_rates(table(spark, d, "records"))


@query("""SELECT cause, count(*) AS n, count(*) FILTER (WHERE malformed) AS "false", round(avg(malformed::INT), 6) AS rate
FROM {records} WHERE arm = 'RA' AND passed GROUP BY cause""")
def false_recovery_rate(spark, d):
    return estimands.false_recovery(table(spark, d, "records").where("arm = 'RA' and passed"), F.col("malformed"))


@query("""SELECT prompt_id, string_agg(criterion_index, ',' ORDER BY criterion_index) AS criteria
FROM (SELECT DISTINCT prompt_id, criterion_index FROM {failures} WHERE root_cause = 'A-F') AS x GROUP BY prompt_id""")
def degenerate_criteria(spark, d):
    rows = table(spark, d, "failures").where("root_cause = 'A-F'").groupBy("prompt_id")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("criterion_index")), ",").alias("criteria"))


HISTOGRAM = "SELECT lang AS model, '{f}' AS field, coalesce({v}, 'none') AS value, count(*) AS n FROM documents GROUP BY ALL"
FINISH = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'length' ELSE 'stop' END"


@query(f"{HISTOGRAM.format(f='finish_reason', v=FINISH)} UNION ALL {HISTOGRAM.format(f='provider', v='source')}")
def finish_and_provider_histograms(spark, d):
    providers = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("provider"))
    return loops.histograms(table(spark, d, "responses").join(providers, "id"), ["finish_reason", "provider"])


@query(None)
def rejected_health(spark, d):
    return loops.rejected_counts(table(spark, d, "responses").where("finish_reason is null").withColumn("reasoning", F.col("response")))


ORACLE_SQL["rejected_health"] = f"""{texts.LOOPS} SELECT d.lang AS model, count(*) AS captured,
count(*) FILTER (WHERE d.doc_id % 2 = 0 AND r.doc_id IS NOT NULL) AS looping FROM documents AS d LEFT JOIN r USING (doc_id) WHERE d.doc_id % 7 = 0 GROUP BY d.lang"""


@query(None)
def response_forensics(spark, d):
    return loops.forensics(table(spark, d, "responses"), ["model", "id"])


ORACLE_SQL["response_forensics"] = f"""{texts.LOOPS} SELECT lang AS model, d.doc_id AS id, finish_reason, CASE WHEN d.doc_id % 2 = 0 THEN length(text) ELSE 0 END AS content_chars, CASE WHEN d.doc_id % 3 = 0 THEN length(text) ELSE 0 END AS reasoning_chars,
looping AND d.doc_id % 2 = 0 AS content_loop, CASE WHEN d.doc_id % 3 = 0 AND text <> '' THEN looping END AS reasoning_loop, looping AND (d.doc_id % 2 = 0 OR d.doc_id % 3 = 0) AS loop_any, finish_reason IS DISTINCT FROM 'stop' AS nonstop_finish
FROM (SELECT *, {FINISH} AS finish_reason, doc_id IN (SELECT doc_id FROM r) AS looping FROM documents) AS d"""


@query("""SELECT kind, count(*) AS n, count(*) FILTER (WHERE passed) AS accepted, round_even(100.0 * count(*) FILTER (WHERE passed) / count(*), 1) AS yield_pct, min(count(*) FILTER (WHERE passed)) OVER () AS target_n FROM {records} WHERE arm = 'SA' GROUP BY kind""")
def source_statistics(spark, d):
    return records.source_stats(table(spark, d, "records").where("arm = 'SA'"), "kind", F.col("passed"))


def _wilson(k: str, n: str, sign: str) -> str:
    z = "1.96::DOUBLE"
    return f"(({k}) / ({n})::DOUBLE + {z} * {z} / (2 * ({n})) {sign} {z} * sqrt(({k}) / ({n})::DOUBLE * (1 - ({k}) / ({n})::DOUBLE) / ({n}) + {z} * {z} / (4 * ({n}) * ({n})))) / (1 + {z} * {z} / ({n}))"


@query(f"""SELECT a.root_cause, a.lo <= coalesce(b.hi, 0) AND coalesce(b.lo, 0) <= a.hi AS overlap FROM
(SELECT root_cause, {_wilson('k', 'n', '-')} AS lo, {_wilson('k', 'n', '+')} AS hi FROM (SELECT root_cause, count(*) AS k, (SELECT count(*) FROM {{failures}} WHERE model = 'm0') AS n FROM {{failures}} WHERE model = 'm0' GROUP BY root_cause) AS x) AS a LEFT JOIN
(SELECT root_cause, {_wilson('k', 'n', '-')} AS lo, {_wilson('k', 'n', '+')} AS hi FROM (SELECT root_cause, count(*) AS k, (SELECT count(*) FROM {{failures}} WHERE model <> 'm0') AS n FROM {{failures}} WHERE model <> 'm0' GROUP BY root_cause) AS x) AS b USING (root_cause)""")
def interval_overlap(spark, d):
    def shares(rows):
        total = rows.agg(F.count(F.lit(1)).alias("n"))  # one row
        counts = rows.groupBy("root_cause").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(total))
        lo, hi = stats.wilson(F.col("k"), F.col("n"))
        return counts.select("root_cause", lo.alias("lo"), hi.alias("hi"))

    rows = table(spark, d, "failures")
    return resample.overlap_rule(shares(rows.where("model = 'm0'")), shares(rows.where("model <> 'm0'")))


@query("""SELECT event_id, json_valid(props)::INT::DOUBLE AS reward, (NOT contains(props, ','))::INT::DOUBLE AS named, 0.0::DOUBLE AS unknown FROM events""")
def json_and_named_scores(spark, d):
    props = F.col("props")
    scores = [verifiers.older_reward(props, [{"type": "json_parses"}]).alias("reward"), verifiers.score("no_commas", props, {}).alias("named")]
    return table(spark, d, "events").select("event_id", *scores, verifiers.score("no such check", props, {}).alias("unknown"))


@query(r"""SELECT doc_id, (len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[^\s]'))) = 12)::INT::DOUBLE AS reward FROM documents""")
def older_sentence_count(spark, d):
    return texts.docs(spark, d).select("doc_id", verifiers.older_reward(F.col("text"), [{"type": "sentence_count", "n": 12}]).alias("reward"))
