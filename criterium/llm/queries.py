"""The queries of this subpackage: thin projections of its operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from criterium.llm._oracles import FINGERPRINTS, LEXICAL, LICENSES
from criterium.llm.common import fresh_path, read


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.neighbours import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_idpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.idpack import read_digests, write_ids

    path = fresh_path(spark, "idpack")
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.toxicity import score

    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.fingerprints import compare

    return compare(read(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).drop("copies")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.packing import pack
    from criterium.llm.tokens import GROUP

    return pack(read(spark, sf_dir, "documents"), group=GROUP, kept=96 << 20).withColumn("piece", F.col("piece").cast("int"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.near_duplicates import groups

    return groups(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.quality import score

    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.html import extract

    return extract(read(spark, sf_dir, "pages"))


def op11_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.expiring import click_windows

    return click_windows(read(spark, sf_dir, "clicks"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.lexical import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from criterium.llm.personal import find

    return find(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_forest, op2_idpack, op3_toxicity, op4_merkle, op5_mix, op6_licenses, op7_pack, op8_near_duplicates, op9_quality, op10_html, op11_expiring, op12_lexical, op13_personal, pipeline)
}

ORACLE_SQL = {
    "op4_merkle": FINGERPRINTS,
    "op6_licenses": LICENSES,
    "op12_lexical": LEXICAL,
    "op5_mix": r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS lim, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, lim / weight) AS level FROM l WHERE lim >= level * weight),
t AS (SELECT w.source, w.source_size, least(w.lim, coalesce(v.level * w.weight, w.lim)) AS target FROM w CROSS JOIN v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.k, d.doc_id) - 1 AS rank,
             CAST('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(least(floor(off + (rank + 1) * each) - floor(off + rank * each), 2) * size AS BIGINT) AS taken FROM r""",
}
