"""Connected components of a graph of links, without a driver-side structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criterium.llm.common import lean, settled

#: Rows that one task takes of a table of links.
ROWS = 500_000


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """As many partitions as the rows need: small tables of links should not leave a file for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) -> every node and the smallest node of its component; links run down to smaller numbers until none moves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)].ravel(), at[len(a) :].ravel()
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (left, right):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def contracted(links: DataFrame) -> DataFrame:
    """The links of each task as stars: no more than one link a node, with the same components."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
            b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
            a, b = joined(a, b)
            a, b = a[a != b], b[a != b]
            if len(a) > ROWS:
                yield pa.record_batch([a, b], names=["a", "b"])
                a, b = a[:0], b[:0]
        if len(a):
            yield pa.record_batch([a, b], names=["a", "b"])

    return links.select("a", "b").mapInArrow(lean(stars), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> node, component (the smallest node of its component).

    Tasks first contract their own links to stars. Up to ``ROWS`` stars are joined in one task; more go
    through alternating large and small stars: every round keeps only links to a smaller node, so the
    links never grow in number, and aggregates are combined before the shuffle and joined back, so that a
    hub's links need no single task.
    """
    links = settled(contracted(edges))
    n = links.count()
    if n > ROWS:
        links, n = _starred(links), 0
    else:
        links = settled(contracted(links.repartition(1)))
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(narrowed(roots, n) if n else roots)


def _starred(edges: DataFrame) -> DataFrame:
    """Links (a, b) of every node to the smallest of its component."""
    links = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    now = links.agg(*mark).first()
    while True:
        before, n = now, now["n"]
        links = narrowed(links, n)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = narrowed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), 2 * n)
        large = narrowed(large.distinct(), n)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        links = settled(narrowed(narrowed(small.where("a <> b"), 2 * n).distinct(), n))
        now = links.agg(*mark).first()
        if now == before:
            return links
