"""Queries over steps and events, and over small statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.functions import stats
from criterium.operators import progress as P
from criterium.operators import ranks
from criterium.plans.catalog import query
from criterium.plans.derive import table


def steps(spark, d):
    return table(spark, d, "steps")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_rate_20(spark, d):
    return P.rolling_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "rolling")


@query("""SELECT user_id, count(*) AS n, round(quantile_cont(rate, 0.5), 3) AS median_rate, round(avg(rate), 3) AS mean_rate FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY step)) / 1e6::DOUBLE AS rate FROM {steps}) AS x WHERE rate IS NOT NULL GROUP BY user_id""")
def step_delta_median(spark, d):
    return P.step_rates(steps(spark, d), ["user_id"], "step", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query("""SELECT user_id, round(avg(value) FILTER (WHERE u <= 10), 6) AS first_mean, round(avg(value) FILTER (WHERE w <= 10), 6) AS last_mean, max(value) FILTER (WHERE u = 1) AS first_value, max(value) FILTER (WHERE w = 1) AS last_value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS u, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS w FROM {steps}) AS x GROUP BY user_id""")
def first_last_window(spark, d):
    return P.edge_means(steps(spark, d), ["user_id"], ["step"], "value", 10)


@query("SELECT user_id, round(avg(value), 6) AS mean FROM {steps} WHERE step BETWEEN 11 AND 20 GROUP BY user_id")
def gate_window(spark, d):
    return P.window_mean(steps(spark, d), ["user_id"], "step", "value", 11, 20)


@query("SELECT user_id, event_type, arg_max(value, step) AS last FROM {steps} WHERE value IS NOT NULL GROUP BY ALL")
def last_metrics(spark, d):
    return P.last_values(steps(spark, d), ["user_id"], "event_type", "value", "step")


@query("""SELECT user_id, round((epoch_us(max(ts)) - epoch_us(max(ts) FILTER (WHERE moved))) / 1e6::DOUBLE, 3) AS idle, (epoch_us(max(ts)) - epoch_us(max(ts) FILTER (WHERE moved))) / 1e6::DOUBLE > 60 AS stale
FROM (SELECT *, lag(event_type) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) AS x GROUP BY user_id""")
def stale_guard(spark, d):
    return P.stale(table(spark, d, "events"), ["user_id"], "ts", "event_type", 60)


@query("SELECT round(sum(greatest(total - done, 0) * coalesce(rate, 2.5)), 6) AS eta_s, CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total FROM (SELECT event_type, count(*) FILTER (WHERE value > 50) AS done, count(*) AS total, CASE WHEN event_type <> 'view' THEN avg(value) END AS rate FROM events GROUP BY event_type) AS x")
def progress_eta(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("done"), F.count(F.lit(1)).alias("total"), F.avg("value").alias("r"))
    return P.eta(rows.withColumn("rate", F.when(F.col("event_type") != "view", F.col("r"))), 2.5)


@query("SELECT user_id, concat_ws(',', CASE WHEN m < 45 THEN 'low' END, CASE WHEN n > 60 THEN 'busy' END, CASE WHEN v > 95 THEN 'peak' END) AS flags FROM (SELECT user_id, avg(value) AS m, count(*) AS n, max(value) AS v FROM events GROUP BY user_id) AS x")
def health_flags(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    return P.health_flags(rows, {"low": F.col("m") < 45, "busy": F.col("n") > 60, "peak": F.col("v") > 95}).select("user_id", "flags")


@query("SELECT event_type, count(*) AS calls, round(sum(event_id) / sum(value), 6) AS tokens_per_s FROM events GROUP BY event_type")
def throughput(spark, d):
    return P.throughput(table(spark, d, "events").select("event_type", F.col("event_id").alias("tokens"), F.col("value").alias("seconds")), ["event_type"])


@query("""SELECT p // 8 AS step, p % 8 AS slot, doc_id FROM (SELECT doc_id, (place - 1 - 5 + 2 * n) % n + lap * n AS p
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('3:', doc_id)), doc_id) AS place, count(*) OVER () AS n FROM documents) AS d CROSS JOIN (VALUES (0), (1)) AS l(lap)) AS x""")
def ring_batches(spark, d):
    return P.ring_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 8, 2, 5, 3)


@query("""SELECT lang, count(*) AS n, min(n_chars) AS least, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS most, round(avg((n_chars > 4000)::INT), 6) AS over_rate, list_sort(list(n_chars))[CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT) + 1] AS p95 FROM documents GROUP BY lang""")
def length_stats(spark, d):
    return P.length_stats(table(spark, d, "documents").select("lang", "n_chars"), ["lang"], "n_chars", 4000)


Z = stats.Z95
WILSON = "CASE WHEN n = 0 THEN {e}::DOUBLE ELSE {f}((k / n::DOUBLE + {z}::DOUBLE * {z}::DOUBLE / (2 * n) {s} {z}::DOUBLE * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {z}::DOUBLE * {z}::DOUBLE / (4.0::DOUBLE * n * n))) / (1 + {z}::DOUBLE * {z}::DOUBLE / n), {e}::DOUBLE) END"


@query(f"SELECT source, round({WILSON.format(e=0.0, f='greatest', s='-', z=Z)}, 6) AS lo, round({WILSON.format(e=1.0, f='least', s='+', z=Z)}, 6) AS hi FROM (SELECT source, count(*) FILTER (WHERE quality = 1) AS k, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) AS x")
def wilson(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("quality").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


RANKS = "SELECT source, CAST(count(*) AS BIGINT) AS a, CAST(sum(n_chars) AS BIGINT) AS b FROM documents GROUP BY source"


@query(f"SELECT count(*) AS pairs, round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) AS tau FROM ({RANKS}) AS x JOIN ({RANKS}) AS y ON x.source < y.source")
def kendall_tau(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("a"), F.sum("n_chars").alias("b"))
    return ranks.kendall_tau(rows, "a", "b").select("pairs", F.round("tau", 6).alias("tau"))


@query(f"""WITH r AS (SELECT o_custkey, count(*) AS a, CAST(max(o_totalprice) AS BIGINT) AS b FROM orders GROUP BY o_custkey)
SELECT count(*) AS pairs, round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) AS tau FROM r AS x JOIN r AS y ON x.o_custkey < y.o_custkey""")
def customer_rank_agreement(spark, d):
    """All customers: how many orders they have against their largest order."""
    orders = table(spark, d, "orders").where("o_custkey is not null")
    rows = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("a"), F.rint(F.max("o_totalprice")).cast("long").alias("b"))
    return ranks.kendall_tau(rows, "a", "b").select("pairs", F.round("tau", 6).alias("tau"))


@query("""SELECT event_type, count(*) AS n, list_sort(list(value))[(count(*) // 4) + 1] AS q1, round(quantile_cont(value, 0.5), 6) AS median, list_sort(list(value))[(3 * count(*) // 4) + 1] AS q3 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def value_quartiles(spark, d):
    found = ranks.elements_at(table(spark, d, "events"), ["event_type"], "value", {"q1": (0.25, lambda n: F.floor(n / 4)), **ranks.MIDDLE, "q3": (0.75, lambda n: F.floor(3 * n / 4))})
    return found.select("event_type", "n", "q1", F.round(ranks.median_of("_low", "_high"), 6).alias("median"), "q3")


@query("SELECT user_id, round(coalesce(regr_slope(value, CAST(step AS DOUBLE)), 0), 6) AS slope FROM {steps} GROUP BY user_id")
def ols_slope(spark, d):
    return stats.linear_slope(steps(spark, d), ["user_id"], "step", "value").select("user_id", F.round("slope", 6).alias("slope"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(0.025::DOUBLE * count(*)) AS BIGINT) + 1] AS lo, list_sort(list(value))[least(CAST(floor(0.975::DOUBLE * count(*)) AS BIGINT), count(*) - 1) + 1] AS hi FROM events GROUP BY event_type")
def percentile_idx(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.collect_list("value").alias("v"))
    return rows.select("event_type", stats.percentile_index(F.col("v"), 0.025).alias("lo"), stats.percentile_index(F.col("v"), 0.975, True).alias("hi"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def percentile_interp(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.025), 6).alias("lo"), F.round(F.percentile("value", 0.975), 6).alias("hi"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    from criterium.streaming.incremental import windowed_counts as counted

    return counted(table(spark, d, "events"), "ts", "1 day", "1 hour").withColumn("total", F.round("total", 6))
