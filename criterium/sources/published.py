"""Tables that readers see whole: versions written aside, switched by one manifest, and what no version needs removed.

A published table is a folder with ``versions/`` and ``manifests/``. A write makes a new version of the partitions
that it brings (by the values of ``by``), then a manifest that names every partition's folder: those it brought, and
the earlier version's for all others. A reader takes the newest manifest that is complete and reads the folders it
names, so it sees the old state or the new one, never a part. A manifest's file comes into being by one rename that
fails if another writer was first. Old versions and manifests stay until :func:`prune`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "partition string, folder string"


class Conflict(RuntimeError):
    """Another writer published first."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at(path))) if files.exists(at(path)) else []


def current(spark: SparkSession, path: str) -> int:
    """The number of the newest manifest, 0 before the first."""
    return max((int(n) for n in _names(spark, f"{path}/manifests") if n.isdigit()), default=0)


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """partition, folder of a state; a row a partition."""
    number = current(spark, path) if number is None else number
    return spark.read.schema(MANIFEST).json(f"{path}/manifests/{number}") if number else spark.createDataFrame([], MANIFEST)


def publish(rows: DataFrame, path: str, by: str, mirror: bool = False) -> int:
    """Replace the partitions that ``rows`` bring, or with ``mirror`` the whole table; the number of the new state.

    Rows without a value of ``by`` are an error. Without rows nothing changes, unless ``mirror`` empties the table.
    """
    spark = rows.sparkSession
    before, version = current(spark, path), f"{path}/versions/{uuid.uuid4().hex}"
    named = rows.withColumn("_part", F.when(F.col(by).isNull(), F.raise_error(F.lit(f"no {by}"))).otherwise(F.sha2(F.col(by).cast("string"), 256)))
    named.write.partitionBy("_part").parquet(version)
    brought = [n.partition("=")[2] for n in _names(spark, version) if n.startswith("_part=")]  # a folder a partition
    kept = [] if mirror else [(r["partition"], r["folder"]) for r in manifest(spark, path, before).where(~F.col("partition").isin(brought)).toLocalIterator()]
    draft = f"{path}/manifests/draft-{uuid.uuid4().hex}"
    spark.createDataFrame([*kept, *((p, f"{version}/_part={p}") for p in brought)], MANIFEST).coalesce(1).write.json(draft)
    files, at = _files(spark, path)
    target = at(f"{path}/manifests/{before + 1}")
    if files.exists(target) or not files.rename(at(draft), target):
        files.delete(at(draft), True)
        raise Conflict(f"state {before + 1} of {path} has been published by another writer")
    return before + 1


def load(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame:
    """The table as of a state, the newest if none is named."""
    folders = [r["folder"] for r in manifest(spark, path, number).collect()]  # a row a partition
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def prune(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the folders that none of the newest ``keep`` states names, and older manifests; the names of what went."""
    newest = current(spark, path)
    states = [n for n in range(max(1, newest - keep + 1), newest + 1)]
    wanted = None
    for n in states:
        wanted = manifest(spark, path, n) if wanted is None else wanted.unionByName(manifest(spark, path, n))
    if wanted is None:
        return []
    files, at = _files(spark, path)
    listed = [(f"{v}/{p}",) for v in _names(spark, f"{path}/versions") for p in _names(spark, f"{path}/versions/{v}") if p.startswith("_part=")]
    stale = spark.createDataFrame(listed, "name string").join(wanted.select(F.regexp_extract("folder", "([^/]+/[^/]+)$", 1).alias("name")), "name", "left_anti")
    gone = sorted(r["name"] for r in stale.collect())
    for name in gone:
        files.delete(at(f"{path}/versions/{name}"), True)
    for name in _names(spark, f"{path}/manifests"):
        if name.isdigit() and int(name) < states[0]:
            files.delete(at(f"{path}/manifests/{name}"), True)
    return gone
