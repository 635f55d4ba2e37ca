"""Queries over repeated decodes: majorities, recovery, sensitivity, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.operators import estimands as E
from criterium.operators import progress, resample
from criterium.plans.catalog import query
from criterium.plans.derive import ARMS, table

MAJORITY = "SELECT arm, cause, prompt_id, criterion_id, 2 * count(*) FILTER (WHERE passed) > count(*) AS passed FROM {records} GROUP BY ALL"
PAIRED = "SELECT b.cause, b.prompt_id, b.criterion_id, b.passed AS base, a.arm, a.passed AS own FROM (SELECT * FROM ({m}) AS x WHERE arm = '0') AS b CROSS JOIN (VALUES ('0'), ('SA'), ('SB'), ('RA'), ('RB')) AS n(name) LEFT JOIN ({m}) AS a ON a.arm = n.name AND a.cause = b.cause AND a.prompt_id = b.prompt_id AND a.criterion_id = b.criterion_id"
COUNTS = "SELECT arm, cause, count(*) FILTER (WHERE NOT base) AS failed, count(*) FILTER (WHERE NOT base AND own) AS recovered, count(*) FILTER (WHERE base) AS held, count(*) FILTER (WHERE base AND NOT own) AS broken FROM ({p}) AS p GROUP BY ALL"


def _counts(majority: str = MAJORITY) -> str:
    return COUNTS.replace("{p}", PAIRED.replace("{m}", majority))


def _contrast(terms, counts: str) -> str:
    return " + ".join(f"({w}) * max(recovered / failed::DOUBLE) FILTER (WHERE arm = '{a}' AND cause = '{c}')" for w, a, c in terms)


def majority(spark, d):
    return E.majority(table(spark, d, "records"), ARMS)


@query(MAJORITY)
def majority_vote(spark, d):
    return majority(spark, d)


@query(f"SELECT *, round(recovered / failed::DOUBLE, 6) AS rec, round(broken / held::DOUBLE, 6) AS brk, recovered - broken AS net FROM ({_counts()}) AS c")
def recovery_breakage(spark, d):
    return E.rates(E.recovery_of_records(table(spark, d, "records"), ARMS))


@query(f"SELECT round({_contrast(E.INTERACTION, '')}, 6) AS contrast FROM ({_counts()}) AS c")
def interaction(spark, d):
    return E.contrast(E.recovery_of_records(table(spark, d, "records"), ARMS), E.INTERACTION).select(F.round("contrast", 6).alias("contrast"))


@query(f"SELECT round({_contrast(E.TARGETING, '')}, 6) AS contrast FROM ({_counts()}) AS c")
def targeting_crossover(spark, d):
    return E.contrast(E.recovery_of_records(table(spark, d, "records"), ARMS), E.TARGETING).select(F.round("contrast", 6).alias("contrast"))


VARIANTS = {
    "V0": "SELECT * FROM {records}",
    "V1": "SELECT * FROM {records} WHERE NOT capped",
    "V2": "SELECT * FROM {records} WHERE prompt_id NOT IN (SELECT prompt_id FROM {records} WHERE capped)",
    "V3": "SELECT * REPLACE (passed OR capped AS passed) FROM {records}",
}


@query(" UNION ALL ".join(f"SELECT '{v}' AS variant, round({_contrast(E.INTERACTION, '')}, 6) AS contrast FROM ({_counts(MAJORITY.replace('{records}', f'({sql}) AS r'))}) AS c" for v, sql in VARIANTS.items()))
def len_capped_variants(spark, d):
    records = table(spark, d, "records")
    out = None
    for v in VARIANTS:
        row = E.contrast(E.recovery_of_records(E.treated(records, v), ARMS), E.INTERACTION).select(F.lit(v).alias("variant"), F.round("contrast", 6).alias("contrast"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT arm, cause, count(*) AS n, round(avg(answer_chars), 6) AS mean_chars, round(avg(marker::INT), 6) AS marker_rate, round(avg(malformed::INT), 6) AS malformed_rate, round(avg(capped::INT), 6) AS capped_rate FROM {records} GROUP BY ALL""")
def artifact_tell(spark, d):
    return E.artifact_tell(table(spark, d, "records"))


@query("""SELECT kind, count(*) AS n, round(avg((NOT passed)::INT) FILTER (WHERE capped), 6) AS capped_fail_rate, round(avg((NOT passed)::INT) FILTER (WHERE NOT capped), 6) AS uncapped_fail_rate,
  count(*) FILTER (WHERE NOT passed) AS failures, count(*) FILTER (WHERE NOT passed AND capped) AS capped_failures, round(count(*) FILTER (WHERE NOT passed AND capped) / nullif(count(*) FILTER (WHERE NOT passed), 0)::DOUBLE, 6) AS capped_share FROM {records} GROUP BY kind""")
def by_type_fail_rate(spark, d):
    return E.kind_rates(table(spark, d, "records"), F.col("kind"))


@query("SELECT cause, round(avg(passed::INT), 6) AS pass_rate FROM (" + MAJORITY + ") AS m WHERE arm = '0' GROUP BY cause")
def base_pass_rate(spark, d):
    return majority(spark, d).where("arm = '0'").groupBy("cause").agg(F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"))


@query("""WITH a AS (SELECT arm, avg(passed::INT) AS accuracy FROM {records} GROUP BY arm) SELECT a.arm, round(a.accuracy, 6) AS accuracy, round(100 * (a.accuracy - b.accuracy), 6) AS delta_pp, a.arm <> '0' AND round(100 * (a.accuracy - b.accuracy), 6) < -3 AS fails
FROM a CROSS JOIN (SELECT accuracy FROM a WHERE arm = '0') AS b""")
def delta_pp_guard(spark, d):
    accuracy = table(spark, d, "records").groupBy("arm").agg(F.avg(F.col("passed").cast("int")).alias("accuracy"))
    return E.delta_guard(accuracy).select("arm", F.round("accuracy", 6).alias("accuracy"), "delta_pp", "fails")


@query("""SELECT arm, kind, count(*) AS n, round(avg(passed::INT), 6) AS rate, CASE WHEN avg(passed::INT) < 0.3 THEN 'hard' WHEN avg(passed::INT) > 0.7 THEN 'easy' ELSE 'band' END AS difficulty FROM {records} GROUP BY ALL""")
def type_difficulty(spark, d):
    rate = F.avg(F.col("passed").cast("int"))
    rows = table(spark, d, "records").groupBy("arm", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(rate, 6).alias("rate"), F.when(rate < 0.3, "hard").when(rate > 0.7, "easy").otherwise("band").alias("difficulty"))
    return rows


@query("""SELECT event_type, user_id, event_id, round(value - avg(value) OVER (PARTITION BY user_id, event_type), 6) AS advantage, max(value) OVER (PARTITION BY user_id, event_type) = min(value) OVER (PARTITION BY user_id, event_type) AS degenerate FROM events""")
def advantage_centering(spark, d):
    return progress.centred(table(spark, d, "events"), ["user_id", "event_type"], "value").select("event_type", "user_id", "event_id", "advantage", "degenerate")


CAUSES = ["A-F", "N-F", "N-O", "R-F"]
BOOTS, SEED = 50, 7


def weight_sql(seed: str, key: str) -> str:
    """The weight of a cluster in draw ``b``: how many steps of the Poisson distribution its 32 bits have reached."""
    bits = f"CAST('0x' || substr(md5(concat_ws(':', {seed}, b // {resample.BLOCK}, {key})), (8 * (b % {resample.BLOCK}) + 1)::INT, 8) AS BIGINT)"
    return f"len(list_filter({resample.poisson_steps()}::BIGINT[], lambda t: t <= {bits}))"


def _share_sql(where: str, seed: int) -> str:
    clusters = f"SELECT prompt_id, {', '.join(f'''count(*) FILTER (WHERE root_cause = '{c}') AS "{c}"''' for c in CAUSES)} FROM {{failures}} WHERE {where} GROUP BY prompt_id"
    sums = f"SELECT b, {', '.join(f'''sum(w * "{c}") AS "{c}"''' for c in CAUSES)} FROM (SELECT *, {weight_sql(seed, 'prompt_id')} AS w FROM ({clusters}) AS c CROSS JOIN (SELECT unnest(range({BOOTS})) AS b) AS d) AS x GROUP BY b"
    total = " + ".join(f'"{c}"' for c in CAUSES)
    return " UNION ALL ".join(f"""SELECT b, '{c}' AS root_cause, "{c}" / ({total})::DOUBLE AS share FROM ({sums}) AS s""" for c in CAUSES)


AT = "list_sort(list({v}))[CAST(floor({q} * count(*)) AS BIGINT) + 1]"


@query(f"SELECT root_cause, round({AT.format(v='share', q=0.025)}, 6) AS lo, round({AT.format(v='share', q=0.975)}, 6) AS hi FROM ({_share_sql('true', SEED)}) AS s GROUP BY root_cause")
def bootstrap_shares_ci(spark, d):
    return resample.share_intervals(table(spark, d, "failures"), CAUSES, BOOTS, SEED)


_OWN, _OTHER = "model = 'm0'", "model <> 'm0'"


@query(f"SELECT root_cause, round({AT.format(v='x', q=0.025)}, 6) AS lo, round({AT.format(v='x', q=0.975)}, 6) AS hi FROM (SELECT root_cause, p.share - q.share AS x FROM ({_share_sql(_OWN, SEED)}) AS p JOIN ({_share_sql(_OTHER, SEED + 1)}) AS q USING (b, root_cause)) AS s GROUP BY root_cause")
def bootstrap_share_difference(spark, d):
    rows = table(spark, d, "failures")
    return resample.share_difference(rows.where(_OWN), rows.where(_OTHER), CAUSES, BOOTS, SEED)


def _per_prompt(arms: str, cause: str) -> str:
    return f"SELECT arm, cause, prompt_id, count(*) FILTER (WHERE NOT base) AS failed, count(*) FILTER (WHERE NOT base AND own) AS recovered FROM ({PAIRED.replace('{m}', MAJORITY)}) AS p WHERE arm IN ({arms}) AND {cause} GROUP BY ALL"


@query(f"""SELECT 'all' AS cut, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM (SELECT b, sum(w * recovered) / sum(w * failed)::DOUBLE AS x FROM
(SELECT *, {weight_sql('11', 'prompt_id')} AS w FROM ({_per_prompt("'RA'", "cause = 'coverage'")}) AS c CROSS JOIN (SELECT unnest(range({BOOTS})) AS b) AS d) AS w GROUP BY b) AS t""")
def bootstrap_recovery_ci(spark, d):
    rows = E.recovery_of_records(table(spark, d, "records").where("cause = 'coverage'"), ["RA"], by=["prompt_id"])
    return resample.statistic_interval(rows, "prompt_id", ["failed", "recovered"], F.expr("try_divide(recovered, failed)"), BOOTS, 11)


@query(f"""SELECT arm, cause, round({AT.format(v='x', q=0.025)}, 6) AS lo, round({AT.format(v='x', q=0.975)}, 6) AS hi FROM (SELECT arm, cause, b, CASE WHEN sum(w * failed) > 0 THEN sum(w * recovered) / sum(w * failed)::DOUBLE ELSE 0 END AS x FROM
(SELECT *, {weight_sql('13', "concat_ws(':', arm, cause, prompt_id)")} AS w FROM ({_per_prompt("'SA', 'RA'", "true")}) AS c CROSS JOIN (SELECT unnest(range({BOOTS})) AS b) AS d) AS w GROUP BY arm, cause, b) AS t GROUP BY arm, cause""")
def bootstrap_recovery_by_arm(spark, d):
    rows = E.recovery_of_records(table(spark, d, "records"), ["SA", "RA"], by=["cause", "prompt_id"])
    return resample.recovery_intervals(rows, BOOTS, 13)
