"""Evaluation tables derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

JUDGES = ["a", "b", "c"]
ARMS = ["0", "SA", "SB", "RA", "RB"]

CELL = """SELECT l_orderkey AS prompt_id, CAST(l_linenumber AS BIGINT) AS criterion_index, concat('m', CAST(l_orderkey % 3 AS STRING)) AS model,
  min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t, min(l_returnflag) AS rf, min(l_linestatus) AS ls
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

TABLES = {
    "cell": CELL,
    "votes": f"""SELECT prompt_id, criterion_index, model, judge, judge_ord,
  CASE judge WHEN 'a' THEN CASE WHEN q >= 20 THEN 'PASS' ELSE 'FAIL' END WHEN 'b' THEN CASE WHEN d <= 0.05 THEN 'PASS' ELSE 'FAIL' END
    ELSE CASE WHEN t <= 0.04 THEN 'PASS' ELSE 'FAIL' END END AS verdict,
  CASE WHEN judge = 'a' AND rf = 'R' AND q < 12 THEN 'judge_refusal: declined' WHEN judge = 'b' AND rf = 'A' AND d >= 0.08 THEN 'judge_truncated'
    WHEN judge = 'c' AND ls = 'F' AND t >= 0.07 THEN 'missing_in_judge_output'
    WHEN judge = 'a' AND q < 20 THEN CASE WHEN ls = 'F' THEN 'off' ELSE 'short' END WHEN judge = 'b' AND d > 0.05 THEN 'off' WHEN judge = 'c' AND t > 0.04 THEN 'late' ELSE '' END AS reason
FROM ({CELL}) AS c CROSS JOIN (VALUES ('a', 0), ('b', 1), ('c', 2)) AS j(judge, judge_ord) WHERE NOT (judge = 'c' AND criterion_index = 7)""",
    "prompts": """SELECT o_orderkey AS prompt_id, o_orderpriority AS instruction_type, o_orderstatus AS prompt_style, c_mktsegment AS use_case
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "failures": f"""SELECT prompt_id, criterion_index, model, concat(rf, '-', ls) AS root_cause, CASE WHEN q < 8 THEN 2 WHEN q < 14 THEN 1 END AS taxonomy_version, d
FROM ({CELL}) AS c WHERE q < 20""",
    "records": """SELECT arm, CASE WHEN l_orderkey % 2 = 0 THEN 'coverage' ELSE 'precision' END AS cause, l_orderkey AS prompt_id,
  concat(CAST(l_orderkey AS STRING), '#c', CAST(l_linenumber AS STRING), ':', l_shipkind) AS criterion_id, l_shipkind AS kind,
  CASE arm WHEN '0' THEN l_quantity >= 25 WHEN 'SA' THEN l_quantity >= 22 OR l_discount <= 0.02 WHEN 'SB' THEN l_quantity >= 20
    WHEN 'RA' THEN l_quantity >= 15 OR l_tax <= 0.01 ELSE l_quantity >= 12 END AS passed,
  l_quantity >= 45 AS capped, CAST(floor(l_extendedprice) AS BIGINT) AS answer_chars, l_returnflag = 'N' AS marker, l_discount >= 0.09 AS malformed
FROM (SELECT *, CASE WHEN l_tax <= 0.02 THEN 'casing' WHEN l_tax <= 0.05 THEN 'title' ELSE 'word_count' END AS l_shipkind FROM {lineitem}) AS l
CROSS JOIN (VALUES ('0'), ('SA'), ('SB'), ('RA'), ('RB')) AS a(arm)""",
    "steps": """SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM {events}""",
    "responses": """SELECT lang AS model, doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN doc_id % 3 = 0 THEN text END AS reasoning, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS response FROM {documents}""",
}
NAMES = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str, by: dict[str, str] | None = None) -> DataFrame:
    """A derived table, or one of the driver's. ``by``: of the driver's tables, the column that their rows are dealt by, so that what groups and joins by it is dealt once."""
    if name not in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return rows.repartition(by[name]) if by and name in by else rows
    sql = TABLES[name]
    return spark.sql(sql, **{n: table(spark, sf_dir, n, by) for n in set(NAMES.findall(sql))})


def oracle(sql: str) -> str:
    """SQL over ``{name}`` of derived tables -> SQL over the driver's tables alone."""
    while found := NAMES.search(sql):
        name = found[1]
        sql = sql.replace(found[0], f"({oracle(TABLES[name])})" if name in TABLES else name)
    return sql
