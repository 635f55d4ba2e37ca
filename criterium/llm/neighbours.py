"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Each of ``TREES`` trees writes a vector as a string: first the largest of up to ``FIRST`` coordinates of a
random rotation, with its sign, then ``LATER`` times the larger of two further random coordinates. It
keeps the strings as a sorted array. (Strings of hyperplane signs had to read 77 % of nearly random
vectors for a recall of 0.9; where vectors differ in most directions, a rotation's largest coordinate
tells near from far far better.) A query descends each tree to its longest prefix match by binary
search; then all trees ascend together, one symbol at a time, until the rows under the shared prefixes
are ``reach`` x the rows of the block and ``LEAST`` (a row counts once for each tree that finds it). Those rows are the
candidates; their inner products are computed exactly. For inner products, vectors get one more
coordinate that brings all to the same length (queries get 0 there), so the nearest direction is the
largest product.

Rows are dealt by a hash of their id into blocks of about ``BLOCK`` rows, each with a forest of its
own that indexes every row of it; a row goes to one block, and a query, hashed once, to every block,
which is a stated query set against all rows, in blocks. A task holds one block and takes its queries
as they come. Equal vectors are indexed once and give all their rows.

Defined cases: vectors that are null, empty, zero, or hold a null or a number that is not finite
take no part, nor do rows without an id; vectors meet those of the same length only; a query id that
is repeated asks once, with one of its vectors; rows that repeat an id are candidates each; rows with a query's own id are not its candidates; an empty
table gives no rows; fewer candidates than ``k`` give fewer rows, and then all of them are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from criterium.llm.common import claim, lean

TREES, FIRST, LATER, REACH, BLOCK = 128, 64, 8, 0.25, 16_384
#: Rows that trees hold together at least; a block of so few that they are never reached is read whole.
LEAST = 2000
#: Queries that are hashed or searched at a time.
BATCH = 512
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@lru_cache(maxsize=4)
def directions(dim: int, trees: int, seed: int) -> list[np.ndarray]:
    """Per tree, orthogonal directions for the first symbol, then two for each later one."""
    found = []
    for t in range(trees):
        rng = np.random.default_rng([seed, dim, t])
        first = np.linalg.qr(rng.normal(size=(dim + 1, min(FIRST, dim + 1))))[0]
        found.append(np.hstack([first, rng.normal(size=(dim + 1, 2 * LATER))]).astype(np.float32))
    return found


def strings(x: np.ndarray, extra: np.ndarray, trees: int = TREES, seed: int = 11) -> np.ndarray:
    """Hash strings (trees x rows) as numbers, first symbol highest, two bits for each later one."""
    longest = np.sqrt((x * x).sum(axis=1) + extra * extra).max(initial=1e-300)
    full = (np.hstack([x, extra[:, None]]) / longest).astype(np.float32)
    out, rows = np.empty((trees, len(x)), np.int32), np.arange(len(x))
    for t, flat in enumerate(directions(x.shape[1], trees, seed)):
        y = full @ flat
        first = y[:, : -2 * LATER]
        at = np.abs(first).argmax(axis=1)
        code = 2 * at + (first[rows, at] > 0)
        for k in range(2 * LATER, 0, -2):
            a, b = y[:, -k], y[:, len(flat[0]) - k + 1]
            larger = np.abs(a) >= np.abs(b)
            code = 4 * code + 2 * larger + (np.where(larger, a, b) > 0)
        out[t] = code
    return out


class Forest:
    def __init__(self, x: np.ndarray, longest: float, trees: int = TREES):
        self.x = x
        codes = strings(x, np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1))), trees)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def ranges(self, codes: np.ndarray, want: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree, the rows of the sorted array under the prefix at which all trees together hold ``want`` rows."""
        trees, n = self.sorted.shape
        lo, hi = np.zeros((codes.shape[1], trees), np.int64), np.full((codes.shape[1], trees), n)
        climbing = np.arange(codes.shape[1])
        for s in range(0, 2 * LATER + 1, 2):
            if not len(climbing):
                break
            for t in range(trees):
                prefix = codes[t, climbing] >> s
                lo[climbing, t] = np.searchsorted(self.sorted[t], prefix << s)
                hi[climbing, t] = np.searchsorted(self.sorted[t], (prefix + 1) << s)
            climbing = climbing[(hi[climbing] - lo[climbing]).sum(axis=1) < want]
        lo[climbing], hi[climbing] = 0, n
        return lo, hi

    def search(self, q: np.ndarray, codes: np.ndarray, k: int, reach: float, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Yields per query (rows, inner products) of the candidates that can be among the k nearest, and the number of all candidates."""
        n = self.x.shape[0]
        lo, hi = self.ranges(codes, max(reach * n, least, 4 * k))
        for i in range(len(q)):
            seen = np.zeros(n, bool)
            for t in range(len(self.order)):
                seen[self.order[t, lo[i, t] : hi[i, t]]] = True
            rows = np.flatnonzero(seen)
            rough = self.x[rows] @ q[i]
            candidates = len(rows)
            if len(rows) > k:
                rows = rows[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())]
            yield rows, (self.x[rows] * q[i]).sum(axis=1), candidates


class Block:
    """A forest over the distinct vectors of a block, with the ids of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, which = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        self.by = np.argsort(which.ravel(), kind="stable")  # rows of equal vectors, by id
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(first)))])
        self.forest = Forest(x[first], longest)

    def search(self, ids: np.ndarray, q: np.ndarray, codes: np.ndarray, k: int, reach: float) -> Iterator[tuple[int, int, float]]:
        for qid, (rows, scores, _) in zip(ids.tolist(), self.forest.search(q, codes, k + 1, reach)):
            own = ((-s, int(i)) for r, s in zip(rows, scores) for i in self.ids[self.by[self.begin[r] : min(self.begin[r + 1], self.begin[r] + k + 1)]] if i != qid)
            for s, i in sorted(own)[:k]:
                yield qid, i, float(-s)


def matrix(columns: list[pa.Array]) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in columns])


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, reach: float = REACH, block: int = BLOCK) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> query_id, rank, vec_id, score for the rows where ``is_query`` holds."""
    x = F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), F.col("embedding").cast("array<double>").alias("x"))
    limit = F.lit(float("inf"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)) & F.exists(x, lambda v: v != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fit).withColumn("dim", F.size(x))
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    shape = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("queries"), F.sqrt(F.max(norm)).alias("longest")).where("queries > 0")
    # one row for each length of vector
    shape = F.broadcast(shape.select("dim", "longest", F.ceil(F.col("n") / block).cast("int").alias("blocks")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vectors", directions.cache_clear)
        for batch in batches:
            for dim in np.unique(batch.column(0).to_numpy()):
                own = batch.filter(pa.array(batch.column(0).to_numpy() == dim))
                for b in range(0, own.num_rows, BATCH):
                    part = own.slice(b, BATCH)
                    q = matrix([part.column(2)])
                    codes = np.ascontiguousarray(strings(q, np.zeros(len(q))).T)
                    yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["dim", "vec_id", "x", "codes"])

    queries = rows.where("asks").dropDuplicates(["vec_id", "dim"]).select("dim", "vec_id", "x").mapInArrow(lean(hashed), "dim int, vec_id long, x array<double>, codes binary")
    queries = queries.join(shape, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "x", "longest", "codes")
    data = rows.join(shape, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "x", "longest", F.lit(None).cast("binary").alias("codes"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vectors", directions.cache_clear)
        key, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for b, e in zip(edges[:-1], edges[1:]):
                if b == e:
                    continue
                part, own = batch.slice(b, e - b), tuple(keys[:2, b])
                if own != key:
                    key, held, index = own, [], None
                if not keys[2, b]:
                    held.append(part)
                elif held or index:
                    if index is None:
                        ids = np.concatenate([p.column(3).to_numpy() for p in held])
                        index = Block(ids, matrix([p.column(4) for p in held]), held[0].column(5)[0].as_py() * (1 + 1e-12))
                        held = []
                    for s in range(0, part.num_rows, BATCH):
                        ask = part.slice(s, BATCH)
                        codes = np.frombuffer(b"".join(ask.column(6).to_pylist()), np.int32).reshape(ask.num_rows, -1).T
                        found = list(index.search(ask.column(3).to_numpy(), matrix([ask.column(4)]), codes, k, reach))
                        if found:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), FOUND)], schema=FOUND)

    both = data.unionByName(queries).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "vec_id")
    found = both.mapInArrow(lean(search), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
