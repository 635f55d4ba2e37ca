"""Queries of the stability analysis: two runs of failures, four cuts."""

from __future__ import annotations

from criterium.operators import stability
from criterium.plans.catalog import query
from criterium.plans.derive import table
from criterium.plans.training import AT, BOOTS, CAUSES, weight_sql

SEED, K = 20260708, 3
RUN = "CASE WHEN criterion_index <= 3 THEN 'r1' ELSE 'r2' END"

ROWS = f"SELECT *, {RUN} AS run FROM {{failures}} WHERE root_cause IN ({', '.join(map(repr, CAUSES))})"
CUTS = f"""SELECT CASE run WHEN 'r1' THEN 'earlier' ELSE 'later' END AS cut, * FROM ({ROWS}) AS x
UNION ALL SELECT CASE WHEN prompt_id IN (SELECT prompt_id FROM ({ROWS}) AS e WHERE run = 'r1') THEN 'later_shared' ELSE 'later_disjoint' END, * FROM ({ROWS}) AS y WHERE run = 'r2'"""
Z = "1.959963984540054::DOUBLE"
WILSON = f"(n / n_rows::DOUBLE + {Z} * {Z} / (2 * n_rows) {{sign}} {Z} * sqrt(n / n_rows::DOUBLE * (1 - n / n_rows::DOUBLE) / n_rows + {Z} * {Z} / (4 * n_rows * n_rows))) / (1 + {Z} * {Z} / n_rows)"
RANKED = f"""SELECT cut, root_cause, n, row_number() OVER (PARTITION BY cut ORDER BY n DESC, root_cause) AS rank, round(n / n_rows::DOUBLE, 6) AS share, n_rows, n_prompts,
  round(greatest({WILSON.format(sign='-')}, 0), 6) AS wilson_lo, round(least({WILSON.format(sign='+')}, 1), 6) AS wilson_hi
FROM (SELECT cut, root_cause, count(*) AS n FROM ({CUTS}) AS c GROUP BY ALL) AS k JOIN (SELECT cut, count(*) AS n_rows, count(DISTINCT prompt_id) AS n_prompts FROM ({CUTS}) AS c GROUP BY cut) AS t USING (cut)"""


def _samples(cut: str, seed: int) -> str:
    """cut, b, root_cause, share, drawn with this seed."""
    each = f"SELECT cut, b, root_cause, sum(n * w) AS n FROM (SELECT *, {weight_sql(seed, 'prompt_id')} AS w FROM (SELECT cut, prompt_id, root_cause, count(*) AS n FROM ({CUTS}) AS c WHERE {cut} GROUP BY ALL) AS p CROSS JOIN (SELECT unnest(range({BOOTS})) AS b) AS d) AS x GROUP BY ALL"
    return f"SELECT cut, b, root_cause, n / sum(n) OVER (PARTITION BY cut, b)::DOUBLE AS share FROM ({each}) AS s"


LIMITS = f"SELECT cut, root_cause, round({AT.format(v='share', q=0.025)}, 6) AS lo, round({AT.format(v='share', q=0.975)}, 6) AS hi FROM ({_samples('true', SEED)}) AS s GROUP BY cut, root_cause"
TABLE = f"SELECT * FROM ({RANKED}) AS r JOIN ({LIMITS}) AS l USING (cut, root_cause)"


def cuts(spark, d):
    rows = table(spark, d, "failures").selectExpr("*", f"{RUN} AS run")
    return stability.clusters(rows, "run", "r1", "r2", CAUSES)


@query(TABLE)
def stability_cuts(spark, d):
    return stability.cut_table(cuts(spark, d), CAUSES, BOOTS, SEED)


@query(f"""SELECT root_cause, round({AT.format(v='x', q=0.025)}, 6) AS lo, round({AT.format(v='x', q=0.975)}, 6) AS hi FROM (
SELECT root_cause, coalesce(a.share, 0) - coalesce(e.share, 0) AS x FROM ({_samples("cut = 'later'", SEED)}) AS a FULL JOIN ({_samples("cut = 'earlier'", SEED + 1)}) AS e USING (b, root_cause)) AS s GROUP BY root_cause""")
def stability_deltas(spark, d):
    return stability.deltas(cuts(spark, d), CAUSES, BOOTS, SEED)


@query(f"""WITH r AS ({RANKED}), b AS (SELECT r.cut, r.rank, e.rank AS before FROM r JOIN (SELECT root_cause, rank FROM r WHERE cut = 'earlier') AS e USING (root_cause) WHERE cut <> 'earlier')
SELECT cut, (SELECT count(*) FROM b AS z WHERE z.cut = x.cut) AS n_common, round(avg(sign(y.before - x.before)), 6) AS tau FROM b AS x JOIN b AS y USING (cut) WHERE x.rank < y.rank GROUP BY cut""")
def stability_ranks(spark, d):
    return stability.rank_agreement(stability.ranking(cuts(spark, d), CAUSES))


TOP = f"array_to_string(list_sort(list(root_cause) FILTER (WHERE cut = '{{cut}}' AND rank <= {K})), ',')"


@query(f"""WITH t AS ({TABLE}), o AS (SELECT count(*) AS n FROM (SELECT * FROM t WHERE cut = 'earlier' AND rank <= {K}) AS e LEFT JOIN (SELECT * FROM t WHERE cut = 'later') AS l USING (root_cause)
WHERE coalesce(l.lo, 0) <= e.hi AND e.lo <= coalesce(l.hi, 0)), s AS (SELECT {TOP.format(cut='earlier')} AS earlier_top, {TOP.format(cut='later')} AS later_top FROM t)
SELECT *, earlier_top = later_top AS set_holds, n AS n_overlap, earlier_top = later_top AND n = len(string_split(earlier_top, ',')) AS confirmed FROM s, o""".replace("SELECT *, earlier_top =", "SELECT earlier_top, later_top, earlier_top ="))
def stability_decision(spark, d):
    return stability.decision(stability.cut_table(cuts(spark, d), CAUSES, BOOTS, SEED), K)


CONCUR, AUTO = "d >= 0.05 AND criterion_index <> 2", "taxonomy_version = 2"


@query(" UNION ALL ".join(f"""SELECT proxy, n_rows, top, top = (SELECT array_to_string(list_sort(list(root_cause)), ',') FROM (SELECT root_cause FROM {{failures}} GROUP BY root_cause ORDER BY count(*) DESC, root_cause LIMIT {K}) AS f) AS matches
FROM (SELECT '{name}' AS proxy, CAST(sum(n) AS BIGINT) AS n_rows, array_to_string(list_sort(list(root_cause) FILTER (WHERE place <= {K})), ',') AS top
FROM (SELECT root_cause, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root_cause) AS place FROM {{failures}} WHERE {where} GROUP BY root_cause) AS x) AS y""" for name, where in (("full", "true"), ("concur", CONCUR), ("auto", AUTO))))
def stability_proxies(spark, d):
    return stability.proxies(table(spark, d, "failures"), {"concur": CONCUR, "auto": AUTO}, K)
