"""A training corpus from raw documents: toxicity, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. :func:`run` writes every stage as Parquet into the shared
folder and reads it again, so a lost executor recomputes a part of one stage at most; what a stage has
read goes when it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from criterium.llm.common import fresh_path, read, remove
from criterium.llm.mixing import mixed
from criterium.llm.near_duplicates import keep_one
from criterium.llm.packing import pack
from criterium.llm.quality import reject as reject_poor
from criterium.llm.toxicity import reject as reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted poor go."""
    return reject_poor(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their sources' target weights, 150 % of the words that come in, each up to twice."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Classifiers and near-duplicate groups are not expressible in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
