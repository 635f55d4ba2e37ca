"""Session and lineage helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_caches: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Python workers are used again by later stages: the operator that starts here empties the caches of all others."""
    _caches.setdefault(owner, clear)
    for name, empty in _caches.items():
        if name != owner:
            empty()


def lean(work: Callable) -> Callable:
    """``work`` of mapInArrow, which gives the memory that it freed back to the machine when a task ends: workers wait for later stages."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            _release()

    return run


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of this machine if all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="criterium-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`fresh_path`, through Spark's own file systems."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a folder of :func:`fresh_path`, if it is there, and say whether it was; the folder that it comes to is made first."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = source.getFileSystem(hadoop)
    files.mkdirs(target.getParent())
    if not files.exists(source):
        return False
    if not files.rename(source, target):
        raise OSError(f"{path} could not be moved to {to}")
    return True


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; a lost executor does not recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 1 << 17


def small(df: DataFrame) -> DataFrame:
    """A settled or written table of narrow rows, to be broadcast if it has at most ``BROADCAST_ROWS`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Add each row's 0-based position within its group, in the given order.

    The rows are range-partitioned by group and order, so that a hot group spreads over many
    tasks; positions within a partition come from ``monotonically_increasing_id`` and a small
    table of run lengths (one row per group and partition) supplies the offsets. Nulls in the
    group columns form a group of their own.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    rows = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    runs = rows.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    runs = small(settled(runs))
    match = rows["_part"] == runs["_in"]
    for g in group:
        match = match & same(rows[g], runs[f"_{g}"])
    return rows.join(runs, match).withColumn(name, F.col("_row") + F.col("_shift")).select(*df.columns, name)
