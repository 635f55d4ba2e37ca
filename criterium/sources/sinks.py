"""Sinks: appends, upserts, merges, repairs, the results document, tables for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those with the same keys."""
    return existing.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def index_order(df: DataFrame) -> DataFrame:
    """Experiments by number, those without one last, then by slug."""
    return df.orderBy(F.col("number").asc_nulls_last(), "slug")


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two maps: new keys win, others stay."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def repaired(existing: DataFrame, replacement: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in place of those with the same keys; only keys that exist are replaced."""
    return existing.join(replacement, keys, "left_anti").unionByName(replacement.join(existing.select(*keys), keys, "left_semi"))


def stale_files(listed: DataFrame, keep: DataFrame, preserved: list[str]) -> DataFrame:
    """Files to delete: listed, not kept, not preserved."""
    return listed.join(keep, "name", "left_anti").where(~F.col("name").isin(preserved))


def log_union(frames: list[DataFrame]) -> DataFrame:
    """Logs with different columns under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bundle(validation: DataFrame, responses: DataFrame) -> DataFrame:
    """Validation rows with the full response, or the excerpt where it is missing."""
    full = responses.select("model", "id", F.col("response").alias("full"))
    return validation.join(full, ["model", "id"], "left").withColumn("response", F.coalesce("full", "response_excerpt")).drop("full")


def committed_labels(bundle: DataFrame, remote: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Labels to commit: a staged edit, else the remote's, else the bundle's."""
    r, s = remote.select(*keys, F.col("human").alias("remote")), staged.select(*keys, F.col("human").alias("staged"))
    return bundle.join(r, keys, "left").join(s, keys, "left").withColumn("human", F.coalesce("staged", "remote", "human")).drop("remote", "staged")


def results_document(meta: dict[str, str], summary: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """place, line: the lines of a run's document, a JSON object of meta, summary (a row a model) and prompts (a line each, in order of
    ``key``, which no two prompts share and none lacks).

    No task holds more than some lines: that one is first, which needs no comma before it, is told by the least key.
    """
    s = summary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "pass_rate")))).alias("criterion_pass_rate"))
    info = F.create_map(*(F.lit(x) for kv in sorted(meta.items()) for x in kv))
    head = F.to_json(F.struct(info.alias("meta"), F.struct("criterion_pass_rate").alias("summary")))
    none = F.lit(None).cast(prompts.schema[key].dataType).alias("_key")
    opening = s.select(head.alias("_h")).select(F.lit(0).alias("place"), none, F.concat(F.expr("left(_h, length(_h) - 1)"), F.lit(', "prompts": [')).alias("line"))
    least = prompts.agg(F.min(key).alias("_least"))  # one row
    comma = F.when(F.col(key).eqNullSafe(F.col("_least")), "").otherwise(", ")
    lines = prompts.crossJoin(F.broadcast(least)).select(F.lit(1).alias("place"), F.col(key).alias("_key"), F.concat(comma, F.to_json(F.struct(*prompts.columns))).alias("line"))
    closing = prompts.sparkSession.range(1).select(F.lit(2).alias("place"), none, F.lit("]}").alias("line"))
    return opening.unionByName(lines).unionByName(closing)


def write_document(lines: DataFrame, path: str) -> None:
    """The document's lines as part files that follow each other in order; put one behind the other they are the document."""
    lines.repartitionByRange("place", "_key").sortWithinPartitions("place", "_key").select("line").write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame) -> str:
    """A small result as a Markdown table, on the driver."""
    lines = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + [f"| {' | '.join(str(v) for v in r)} |" for r in rows.collect()])


def session_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    return spark.createDataFrame(records, schema)
