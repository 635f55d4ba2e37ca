"""A query over a batch service: two rounds of verdicts on every document, from a stand-in that answers by hash."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from criterium.functions.text import cell_id
from criterium.plans.catalog import query
from criterium.plans.derive import table
from criterium.sources import batches
from criterium.sources.shared import scratch


def answer(custom_id: str, attempt: int) -> tuple[str, str | None, str | None]:
    """By the first digit of md5(custom_id:attempt): what a judge's batch may bring."""
    digit = md5(f"{custom_id}:{attempt}".encode()).hexdigest()[0]
    n = 1 + int(custom_id.rpartition("__")[2]) % 3
    listed = "[" + ", ".join('"' + ("PASS" if i % 2 else "FAIL") + '"' for i in range(n)) + "]"
    return {
        "0": ("errored", None, None), "1": ("expired", None, None), "2": ("succeeded", "I would rather not.", "refusal"), "3": ("succeeded", listed[:4], "max_tokens"),
        "4": ("succeeded", "as [you] said", "end_turn"), "5": ("succeeded", '["PASS", "PASS", "PASS", "PASS"]', "end_turn"), "6": ("succeeded", f"```json\n{listed}\n```", "end_turn"),
    }.get(digit, ("succeeded", f"Here: {listed} - done", "end_turn"))


_ERROR = """CASE d{k} WHEN '0' THEN 'judge_parse_error: batch result errored' WHEN '1' THEN 'judge_parse_error: batch result expired' WHEN '2' THEN 'judge_refusal' WHEN '3' THEN 'judge_truncated'
WHEN '4' THEN 'judge_parse_error: no list' WHEN '5' THEN 'judge_parse_error: wrong number of verdicts' END"""


@query(f"""SELECT doc_id, CASE WHEN once THEN 1 ELSE 2 END AS attempts, CASE WHEN once THEN e1 ELSE e2 END AS error,
CASE WHEN (CASE WHEN once THEN e1 ELSE e2 END) IS NULL THEN array_to_string(['FAIL', 'PASS', 'FAIL'][1:(1 + doc_id % 3)::INT], ',') END AS verdicts
FROM (SELECT *, coalesce(e1, 'judge_refusal') = 'judge_refusal' AS once FROM (SELECT doc_id, {_ERROR.format(k=1)} AS e1, {_ERROR.format(k=2)} AS e2
FROM (SELECT doc_id, left(md5(lang || '__' || doc_id || ':1'), 1) AS d1, left(md5(lang || '__' || doc_id || ':2'), 1) AS d2 FROM documents) AS x) AS y) AS z""")
def batch_rounds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", cell_id(F.col("lang"), F.col("doc_id").cast("string")).alias("custom_id"))
    work = docs.select("custom_id", F.to_json(F.struct(F.lit("verdicts, please").alias("system"), F.col("doc_id"))).alias("body"))
    folder = scratch(spark, "batches")
    options = {"service": "criterium.sources.batches:FolderService", "answer": "criterium.plans.batched:answer", "folder": folder, "run": "r", "poll_seconds": "0"}
    criteria = F.substring_index("custom_id", "__", -1).cast("long") % 3 + 1
    done = batches.run_rounds(work, f"{folder}/kept", options, lambda a: batches.verdict_answers(a, criteria))
    return docs.join(done, "custom_id").select("doc_id", "attempts", "error", F.col("value").alias("verdicts"))
