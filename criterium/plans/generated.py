"""Queries over table-valued functions: generated specifications, parsed properties."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from criterium.functions import generators as G
from criterium.plans.catalog import query
from criterium.plans.derive import table

SEED = 41


def _number(what: str, lo: int, hi: int) -> str:
    return f"({lo} + CAST('0x' || left(md5('{SEED}:' || o_orderkey || ':{what}'), 8) AS BIGINT) % {hi - lo + 1})"


_OP = " ".join(f"WHEN '{k}' THEN CASE WHEN {_number(f'{k}:op', 0, 15)} < {exact} THEN 'exact' WHEN {_number(f'{k}:op', 0, 15)} % 2 = 1 THEN 'min' ELSE 'max' END" for k, (_, _, _, exact) in G.COUNTED.items())
_N = " ".join(f"WHEN '{k}' THEN {_number(f'{k}:n', lo, hi)}" for k, (_, lo, hi, _) in G.COUNTED.items())


@query(f"""SELECT o_orderkey, position, type, CASE type {_OP} WHEN 'caps_word_frequency' THEN CASE {_number('caps:op', 0, 1)} WHEN 0 THEN 'exact' ELSE 'min' END END AS op, CASE type {_N} WHEN 'caps_word_frequency' THEN {_number('caps:n', 1, 3)} END AS n
FROM (SELECT o_orderkey, type, row_number() OVER (PARTITION BY o_orderkey ORDER BY md5('{SEED}:' || o_orderkey || ':kinds:' || type), type) - 1 AS position, {_number('n', 3, 4)} AS most
FROM orders CROSS JOIN (SELECT unnest({G.PRECISION}) AS type) AS k) AS x WHERE position < most""")
def generated_specs(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("precision").alias("archetype"))
    return G.with_generated(rows, "o_orderkey", "archetype", SEED).select("o_orderkey", "position", "type", "op", "n")


def fields(text: str, stop_reason: str | None) -> list[tuple[str, str]]:
    return [(k, json.dumps(v)) for k, v in json.loads(text).items()]


@query("""SELECT event_id, k AS name, json_extract(props, '$.' || k)::VARCHAR AS value, NULL::VARCHAR AS error FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) AS x""")
def parsed_properties(spark, d):
    parse = G.parsing(fields, "name string, value string")
    rows = table(spark, d, "events").select("event_id", "props")
    return rows.lateralJoin(parse(F.col("props").outer(), F.lit(None).cast("string"))).select("event_id", "name", "value", "error")
