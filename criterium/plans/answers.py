"""Queries over noisy answers: JSON that stands somewhere in a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.functions import noisy
from criterium.plans.catalog import query
from criterium.plans.derive import table


@query(r"""SELECT click_id, CAST(date_part('epoch', arrived_at) AS BIGINT) AS arrived, nullif(regexp_extract(props, '\[[^\[\]]*\]'), '') AS found, count(*) AS n FROM clicks GROUP BY ALL""")
def json_arrays(spark, d):
    props = F.coalesce("props", F.lit(""))
    text = F.when(F.col("click_id") % 2 == 0, F.concat(F.lit('got ] ["'), F.coalesce("kind", F.lit("")), F.lit("\\\" [no] "), props)).otherwise(F.concat(F.lit("see [no] ```json\n"), props, F.lit("\n``` and [3")))
    rows = table(spark, d, "clicks").select("click_id", F.col("arrived_at").cast("timestamp").cast("long").alias("arrived"), noisy.first_json_array(text).alias("found"))
    return rows.groupBy("click_id", "arrived", "found").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT click_id, CAST(date_part('epoch', arrived_at) AS BIGINT) AS arrived, CASE WHEN json_valid(props) THEN
array_to_string(list_transform(list_filter(json_extract(props, '$.items[*]'), lambda x: CAST(json_extract(x, '$.qty') AS BIGINT) >= 5)[1:2], lambda x: CAST(json_extract(x, '$.sku') AS VARCHAR)), ',') END AS kept, count(*) AS n
FROM clicks GROUP BY ALL""")
def kept_json_entries(spark, d):
    kept = noisy.entries(F.concat(F.lit("so: "), "props", F.lit(" - done")), "items", lambda e: F.get_json_object(e, "$.qty").cast("int") >= 5, 2)
    rows = table(spark, d, "clicks").select("click_id", F.col("arrived_at").cast("timestamp").cast("long").alias("arrived"), F.array_join(F.transform(kept, lambda e: F.get_json_object(e, "$.sku")), ",").alias("kept"))
    return rows.groupBy("click_id", "arrived", "kept").agg(F.count(F.lit(1)).alias("n"))
