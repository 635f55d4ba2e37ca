"""Joins of records with what they refer to, with what stays unmatched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_specs(decodes: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """decodes and prompts (key, specs) -> every decode with every one of its prompt's specs, numbered from 0."""
    return decodes.join(prompts.select(key, "specs"), key).select(*decodes.columns, F.posexplode("specs").alias("position", "spec"))


def criterion_texts(rows: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """rows (key, criterion_index from 1) and prompts (key, criteria) -> rows with ``criterion``, null where there is none."""
    joined = rows.join(prompts.select(key, "criteria"), key, "left")
    return joined.withColumn("criterion", F.get("criteria", F.col("criterion_index") - 1)).drop("criteria")


def unmatched(rows: DataFrame, by: str, found: Column) -> DataFrame:
    """Per group, how many rows found their other side, and how many did not."""
    return rows.groupBy(by).agg(F.count_if(found).alias("matched"), F.count_if(~found).alias("unmatched"))


def flagged_existence(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with whether their key is among ``ids``."""
    marks = ids.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def cuts(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows with ``cut``: shared where the key is among the others too, else disjoint."""
    return flagged_existence(rows, others, key, "_there").withColumn("cut", F.when(F.col("_there"), "shared").otherwise("disjoint")).drop("_there")
