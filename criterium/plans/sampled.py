"""Queries that select, split, upsert and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from criterium.operators import sampling as S
from criterium.plans.catalog import query
from criterium.plans.derive import table
from criterium.sources import published, sinks
from criterium.sources.shared import scratch


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_in_order(spark, d):
    return S.first_n(docs(spark, d).select("doc_id"), "doc_id", 25)


@query("SELECT doc_id, md5(concat('20260101:', doc_id)) AS draw FROM documents ORDER BY draw, doc_id LIMIT 60")
def seeded_sample(spark, d):
    return S.sample(docs(spark, d).select("doc_id"), ["doc_id"], 60, 20260101)


PLACE = "row_number() OVER (PARTITION BY {s} ORDER BY md5(concat('5:', doc_id)), doc_id)"


@query(f"SELECT * FROM (SELECT doc_id, lang, source, {PLACE.format(s='lang, source')} AS place FROM documents) AS x WHERE place <= 3")
def stratified_sample(spark, d):
    return S.stratified(docs(spark, d), ["lang", "source"], ["doc_id"], 3, 5).drop("n_chars")


@query(f"""WITH s AS (SELECT source, 47 // count(*) OVER () + (row_number() OVER (ORDER BY source) <= 47 % count(*) OVER ())::INT AS quota FROM (SELECT DISTINCT source FROM documents) AS x)
SELECT doc_id, source, place FROM (SELECT doc_id, source, quota, {PLACE.format(s='source')} AS place FROM documents JOIN s USING (source)) AS y WHERE place <= quota""")
def quota_sample(spark, d):
    return S.proportional(docs(spark, d).select("doc_id", "source"), "source", ["doc_id"], 47, 5)


@query(f"SELECT doc_id, lang, place FROM (SELECT doc_id, lang, {PLACE.format(s='lang')} AS place FROM documents) AS x WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang) AS y)")
def parity_downsample(spark, d):
    return S.parity(docs(spark, d).select("doc_id", "lang"), "lang", ["doc_id"], 5)


@query(f"SELECT doc_id, lang, {PLACE.format(s='lang')} AS turn, count(*) OVER (PARTITION BY lang) AS stratum_size FROM documents")
def round_robin(spark, d):
    return S.round_robin(docs(spark, d).select("doc_id", "lang"), "lang", ["doc_id"], 5)


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 100 THEN 'train' ELSE 'holdout' END AS split FROM documents")
def train_holdout_split(spark, d):
    return S.split_by_place(docs(spark, d).select("doc_id", "lang"), ["lang"], ["doc_id"], 100)


COVERED = 30


@query(f"""WITH RECURSIVE p AS (SELECT prompt_id, use_case AS u, instruction_type AS t, prompt_style AS s, md5('6:' || prompt_id) AS draw FROM {{prompts}}),
z AS (SELECT u, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, u) - 1 AS o, count(*) OVER () AS strata FROM p GROUP BY u),
h AS (SELECT u, t, s, min(draw) AS draw, arg_min(prompt_id, (draw, prompt_id)) AS prompt_id FROM p GROUP BY ALL),
g AS (SELECT 0 AS turn, []::VARCHAR[] AS types, []::VARCHAR[] AS styles, []::BIGINT[] AS ids
UNION ALL SELECT turn + 1, CASE WHEN new > 0 THEN list_append(types, b.t) ELSE types END, CASE WHEN new > 0 THEN list_append(styles, b.s) ELSE styles END, CASE WHEN new > 0 THEN list_append(ids, b.prompt_id) ELSE ids END
FROM (SELECT turn, types, styles, ids, max((NOT list_contains(types, h.t))::INT + (NOT list_contains(styles, h.s))::INT) AS new,
  arg_min(h, (-(NOT list_contains(types, h.t))::INT - (NOT list_contains(styles, h.s))::INT, h.draw, h.prompt_id)) AS b
  FROM g JOIN z ON z.o = g.turn % z.strata JOIN h ON h.u = z.u WHERE turn < {COVERED} GROUP BY turn, types, styles, ids) AS x),
c AS (SELECT unnest(ids) AS prompt_id FROM g WHERE turn = {COVERED}),
q AS (SELECT z.u, {COVERED} // strata + (o < {COVERED} % strata)::INT - (SELECT count(*) FROM p WHERE p.u = z.u AND prompt_id IN (SELECT prompt_id FROM c)) AS quota FROM z)
SELECT prompt_id FROM c UNION ALL SELECT prompt_id FROM (SELECT prompt_id, quota, row_number() OVER (PARTITION BY u ORDER BY draw, prompt_id) AS place FROM p JOIN q USING (u) WHERE prompt_id NOT IN (SELECT prompt_id FROM c)) AS y WHERE place <= quota""")
def covering_selection(spark, d):
    return S.covering(table(spark, d, "prompts"), COVERED, 6, key="prompt_id").select("prompt_id")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def index_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return sinks.upsert(old, old.where("k % 3 = 0").withColumn("v", F.col("v") + 1), ["k"])


@query("SELECT n_nationkey AS k, concat('a=1,b=', n_nationkey, ',c=', n_regionkey) AS merged FROM nation")
def manifest_merge(spark, d):
    rows = table(spark, d, "nation")
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("0"))
    new = F.create_map(F.lit("b"), F.col("n_nationkey").cast("string"), F.lit("c"), F.col("n_regionkey").cast("string"))
    pairs = F.transform(F.array_sort(F.map_entries(sinks.merged(old, new))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select(F.col("n_nationkey").alias("k"), F.array_join(pairs, ",").alias("merged"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'fixed' ELSE c_mktsegment END AS v FROM customer")
def repaired_records(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    ours = old.where("k % 5 = 0").select("k")
    fixed = ours.unionByName(ours.select((-F.col("k") - 1).alias("k"))).withColumn("v", F.lit("fixed"))  # half of them are not ours
    return sinks.repaired(old, fixed, ["k"])


@query("SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'staged' WHEN l.quality = 1 THEN 'remote' ELSE d.lang END AS human FROM documents AS d LEFT JOIN labels AS l USING (doc_id)")
def committed_labels(spark, d):
    labels = table(spark, d, "labels")
    remote = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("remote").alias("human"))
    staged = labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("staged").alias("human"))
    return sinks.committed_labels(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("human")), remote, staged, ["id"])


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AS x")
def missing_ids(spark, d):
    return docs(spark, d).select("doc_id").subtract(table(spark, d, "labels").select("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL), b AS (SELECT doc_id, lang, source, n_chars + 1 AS n_chars FROM d WHERE source IN (SELECT source FROM d WHERE lang = 'de') AND doc_id // 20 % 2 = 0)
SELECT * FROM b UNION ALL SELECT doc_id, lang, source, n_chars FROM d WHERE source NOT IN (SELECT source FROM b)""")
def published_sources(spark, d):
    """A table published by source, then half of the rows of sources with German texts, changed, in place of theirs."""
    path, rows = scratch(spark, "published"), docs(spark, d).where("source is not null")
    published.publish(rows, path, "source")
    german = rows.join(rows.where("lang = 'de'").select("source").distinct(), "source", "left_semi")
    published.publish(german.where("doc_id div 20 % 2 = 0").withColumn("n_chars", F.col("n_chars") + 1), path, "source")
    return published.load(spark, path, "doc_id long, lang string, source string, n_chars long")
