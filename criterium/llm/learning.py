"""What the two text classifiers share: labelled samples, calibration, the scoring pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criterium.llm.common import claim, lean

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> tuple[list[tuple[str, int, bool]], dict[int, int]]:
    """At most ``per_class`` learnable rows of each class, and the classes' sizes among learnable rows.

    Rows are (text, label, for_calibration). Learnable rows are labels whose crc32(doc_id as text)
    mod 5 is not 0; the rows are the first of each class by a hash of doc_id, whole texts, so the
    driver holds at most 2 x ``per_class`` texts. A third of them, again by hash, calibrates.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picks = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    ids = picks[0].unionByName(picks[1])  # at most 2 x per_class rows, so the broadcast is bounded
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", "text").collect()
    return [(r["text"], r["y"], r["h"] % 3 == 0) for r in rows], sizes


class Isotonic:
    """Weighted isotonic regression (pool adjacent violators); a step function with linear joins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        order = np.argsort(x, kind="stable")
        xs, first = np.unique(x[order], return_index=True)
        ws = np.add.reduceat(w[order], first)
        ys = np.add.reduceat((w * y)[order], first) / ws
        blocks: list[list[float]] = []  # mean, weight, number of distinct x
        for v, wt in zip(ys, ws):
            blocks.append([v, wt, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v2, w2, n2 = blocks.pop()
                v1, w1, n1 = blocks.pop()
                blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
        self.x, self.y = xs, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0.0, 1.0)


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give a stratified sample the shares of the whole."""
    return np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))


def score_texts(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], threshold: float) -> DataFrame:
    """Every document, whole text -> doc_id, held_out, score, predicted. ``scorer()`` is built once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("scores", lambda: None)
        score = scorer()
        for batch in batches:
            n = batch.num_rows
            if n:
                scores = np.concatenate([score(batch.column(2).slice(k, 256).to_pylist()) for k in range(0, n, 256)])
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], schema=SCORED)

    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_scored(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns, whose score ``keep`` accepts; one pass, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("scores", lambda: None)
        score = scorer()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores = score([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(keep(scores)))

    return docs.mapInArrow(lean(run), docs.schema)
