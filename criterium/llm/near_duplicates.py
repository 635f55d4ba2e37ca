"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the multiset of its five-word shingles (a shorter text is one shingle); a shingle weighs its
count times its inverse document frequency over all documents,

    idf(df) = ln(documents / df) / ln(1 / FREQUENT), at most 1 and at least FLOOR,

see :mod:`criterium.llm.shingles`. The bounds keep groups of copies together: without the upper one, a
word edited in one of c copies weighs more the fewer copies there are, and without the lower one, what
thousands of copies share counts for next to nothing, so that near copies of similarity 0.9 by counts
fall under the threshold.

``BANDS`` x ``ROWS`` consistent weighted samples make a signature; texts that agree on a band share a
bucket. Within buckets signatures link texts that may be similar (an estimate of at least ``LIKELY``,
three standard errors under the threshold), and the components of those links are families. A family's
texts are brought together once, and the exact weighted Jaccard similarity of all its pairs decides.

Buckets and families are dealt into blocks of bounded size, so that none is gathered whole. Each block
is compared within, then the heads of what hangs together are compared with each other (a tight group
of any size soon is one component), and then every pair of blocks is compared, but those inside the
family's largest component, whose texts need no link among each other. So no two texts of a family end
in different classes untested, and the work beyond a linear one is (texts outside of the largest
component) x texts / block.

Defined cases: a null text is an empty one; texts without any word are near-duplicates of equal texts
only; equal texts are one class from the start; rows that repeat a doc_id and text belong together,
rows without doc_id take part, and a class of them alone has class_id null; an empty table gives no
rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from criterium.llm.common import claim, fresh_path, lean, remove, same, settled, small, unused
from criterium.llm.components import components
from criterium.llm.shingles import Weights, frequent_shingles, shingles

SIMILAR = 0.8
BANDS, ROWS = 16, 5
LIKELY = 0.66
#: Texts and shingles of a block.
BLOCK, GRAMS = 1000, 1_000_000
#: Columns of a slice of the shingle matrix of a block; texts whose signatures a task remembers.
COLUMNS, SEEN = 2048, 200_000


class Sampler:
    """Improved consistent weighted sampling; its random variates per (shingle, sample) come from tables by hash."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = 1 << 16
        self.r, self.c, self.beta = rng.gamma(2.0, 1.0, size), np.log(rng.gamma(2.0, 1.0, size)), rng.random(size)
        self.odd = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.one = self._high(self.c - self.r * (1 - self.beta))  # weight 1: t = 0

    @staticmethod
    def _high(log_a: np.ndarray) -> np.ndarray:
        """Numbers as the high 32 bits of integers in the same order."""
        bits = log_a.astype(np.float32).view(np.uint32).astype(np.uint64)
        return np.where(bits >> np.uint64(31), np.uint64(0xFFFFFFFF) - bits, bits + np.uint64(0x80000000)) << np.uint64(32)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (texts x samples, 32 bits each) of texts whose shingles begin at ``starts``."""
        low = hashes & np.uint64(0xFFFFFFFF)
        odd_ones = np.flatnonzero(weights != 1.0)
        logs, own = np.log(weights[odd_ones]), hashes[odd_ones]
        out = np.empty((len(starts), len(self.odd)), np.uint32)
        for k, odd in enumerate(self.odd):
            at = (hashes * odd) >> np.uint64(48)
            key = self.one.take(at) | low
            if len(odd_ones):
                i = at[odd_ones]
                t = np.floor(logs / self.r[i] + self.beta[i])
                mixed = (own + t.astype(np.int64).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) & np.uint64(0xFFFFFFFF)
                key[odd_ones] = self._high(self.c[i] - self.r[i] * (t - self.beta[i] + 1)) | mixed
            out[:, k] = np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for row in range(ROWS):
        key = (key ^ samples[:, row::ROWS][:, :BANDS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(texts: DataFrame, weights: Weights) -> DataFrame:
    """node, text -> node, bands, marks (a byte of each sample), weight, grams; texts without a word are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near", lambda: None)
        sampler, seen = Sampler(), set()
        nodes, hashes, ws, size = [], [], [], 0

        def signed() -> pa.RecordBatch:
            sizes = [len(h) for h in hashes]
            samples = sampler(np.concatenate(hashes), np.concatenate(ws), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            marks = (samples & np.uint32(255)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(nodes) + 1, BANDS), pa.int32()), pa.array(band_keys(samples).ravel()))
            columns = [pa.array(nodes, pa.int64()), bands, pa.array([m.tobytes() for m in marks], pa.binary()), pa.array([float(w.sum()) for w in ws]), pa.array(sizes, pa.int64())]
            return pa.record_batch(columns, names=["node", "bands", "marks", "weight", "grams"])

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node not in seen:
                    seen.add(node)
                    h, c = shingles(text.as_py())
                    if len(h):
                        nodes.append(node)
                        hashes.append(h)
                        ws.append(weights(h, c))
                        size += len(h)
                        if size > 20_000:
                            yield signed()
                            nodes, hashes, ws, size = [], [], [], 0
            if len(seen) > SEEN:
                seen.clear()
        if nodes:
            yield signed()

    return texts.select("node", "text").mapInArrow(lean(sign), "node long, bands array<long>, marks binary, weight double, grams long").dropDuplicates(["node"])


class Groups:
    """Union of members by number; the smallest number stands for a group."""

    def __init__(self, labels: list):
        """Members with the same label belong together from the start."""
        by: dict = {}
        self.root = [by.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)
        return a != b


def pairwise(grams: list[tuple[np.ndarray, np.ndarray]], weights: Weights, side: np.ndarray | None = None) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of texts, given as (shingle hashes, counts); with ``side``, of those of side 0 (rows) with those of side 1.

    The sum of smaller counts is a product of 0/1 matrices: a column says which texts hold a shingle at
    least so often, and weighs the step from the next smaller count. Columns of one text alone are left
    out, the others are multiplied in slices.
    """
    m = len(grams)
    text = np.repeat(np.arange(m), [len(h) for h, _ in grams])
    keys, counts = np.concatenate([h for h, _ in grams]), np.concatenate([c for _, c in grams]).astype(np.int64)
    total = np.bincount(text, weights(keys, counts), m)
    order = np.lexsort((counts, keys))
    keys, counts, text = keys[order], counts[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    keys, counts, text, new = keys[shared], counts[shared], text[shared], new[shared]
    rows, columns = (np.arange(m), np.arange(m)) if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    low = np.zeros((len(rows), len(columns)))
    if len(keys):
        step = new.copy()
        step[1:] |= counts[1:] != counts[:-1]
        level = np.cumsum(step) - 1  # the column of a text's own count; columns of a shingle follow each other
        first = level[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        at = np.flatnonzero(step)
        below = np.where(new[at], 0, np.concatenate([[0], counts[at][:-1]]))
        gain = (counts[at] - below) * weights.idf(keys[at])
        n = level - first + 1
        bounds = np.searchsorted(first, np.arange(0, len(at) + COLUMNS, COLUMNS))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            reach, base = n[lo:hi], first[lo]
            width = int(level[lo:hi].max()) - base + 1
            held = np.zeros((m, width))
            column = np.repeat(first[lo:hi] - base - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            held[np.repeat(text[lo:hi], reach), column] = 1
            right = held if side is None else held[columns]
            low += (held[rows] * gain[base : base + width]) @ right.T
    return low / np.maximum(total[rows][:, None] + total[columns][None, :] - low, 1e-300)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links_of_blocks(rows: DataFrame, payload: str, near) -> DataFrame:
    """rows (key, i, j, side, node, component, weight, payload) -> links (a, b) between texts of block i and block j.

    ``near(payloads, weights, side)`` gives the pairs of members that belong together; members that share
    a component already need no link, and the links of two blocks are a forest.
    """
    rows = rows.select("key", "i", "j", "component", "node", "weight", "side", payload).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "component", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near", lambda: None)
        found: list[tuple[int, int]] = []
        for held in runs(batches, 3):
            labels, nodes, weight, side, loads = zip(*held)
            group = Groups(labels)
            if any(group.root):
                side = np.array(side)
                for i, j in near(loads, np.array(weight), side if side.any() else None):
                    if group.join(i, j):
                        found.append((nodes[i], nodes[j]))
            if len(found) > 50_000:
                yield _pairs(found)
                found.clear()
        if found:
            yield _pairs(found)

    return rows.mapInArrow(lean(link), "a long, b long")


def likely_links(rows: DataFrame) -> DataFrame:
    """Links between texts whose signatures (payload ``marks``) and weights allow similarity."""

    def near(loads: tuple, weight: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
        marks = np.frombuffer(b"".join(loads), np.uint8).reshape(len(loads), -1)
        left = np.arange(len(marks))
        while len(left):  # from each text reached, the texts not yet reached; no two end apart unlooked at
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                hit = (np.minimum(weight[left], weight[i]) >= (SIMILAR - 1e-9) * np.maximum(weight[left], weight[i])) & ((marks[left] == marks[i]).mean(axis=1) >= LIKELY)
                if side is not None:
                    hit &= side[left] != side[i]
                for j in left[hit].tolist():
                    yield i, j
                    queue.append(j)
                left = left[~hit]

    return links_of_blocks(rows, "marks", near)


def similar_links(rows: DataFrame, weights: Weights) -> DataFrame:
    """Links between texts (payload ``text``) whose similarity is verified."""

    def near(loads: tuple, weight: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
        hits = pairwise([shingles(t) for t in loads], weights, side) >= SIMILAR - 1e-9
        if side is None:
            yield from np.argwhere(np.triu(hits, 1)).tolist()
        else:
            rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i, j in np.argwhere(hits):
                yield int(rows[i]), int(columns[j])

    return links_of_blocks(rows, "text", near)


def within(rows: DataFrame, block: Column) -> DataFrame:
    """Rows to be compared inside their blocks alone."""
    return rows.withColumn("i", block.cast("int")).withColumn("j", F.col("i")).withColumn("side", F.lit(0))


def marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component that each node has by now."""
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def split_groups(rows: DataFrame) -> DataFrame:
    """rows (key, component, grams) -> key, components, major, blocks, others: the groups that hold several components.

    ``major`` is the largest component, dealt into ``blocks``, and ``others`` are the blocks of all other
    members. Two blocks together are as large as one block that is compared within.
    """
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("grams").alias("g"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "g", "component")).alias("top"), F.sum("c").alias("c"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("components")).where("components > 1")
    half = lambda c, g: F.ceil(F.greatest(2 * c / BLOCK, 2 * g / GRAMS, F.lit(1))).cast("int")
    return sizes.select("key", "components", F.col("top.component").alias("major"), half(F.col("top.c"), F.col("top.g")).alias("blocks"), half(F.col("c") - F.col("top.c"), F.col("g") - F.col("top.g")).alias("others"))


def block_pairs(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Every row once for each pair (i, j) of blocks of its group that it is part of, with ``side``: 1 for block j, 0 for block i.

    All pairs of blocks are formed but those inside the largest component, whose members need no link
    among each other: what is left outside of it decides how often a row is repeated.
    """
    rows, major = rows.join(split, "key"), F.col("component") == F.col("major")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rows = rows.withColumn("b", F.when(major, F.col("others") + deal("blocks")).otherwise(deal("others")))
    to = F.when(major, F.col("others")).otherwise(F.col("others") + F.col("blocks")) - 1
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), to)))
    rows = rows.withColumn("i", F.least("b", "to")).withColumn("j", F.greatest("b", "to"))
    return rows.withColumn("side", (F.col("b") != F.col("i")).cast("int"))


def resolved(members: DataFrame, large: Column, blocks: Column, link) -> DataFrame:
    """members (key, node, grams, ..) -> node, component: what ``link(rows)`` joins within groups, whatever blocks their members are dealt into."""
    block = F.pmod(F.xxhash64("node", "key"), blocks)
    found = settled(components(link(within(members.withColumn("component", F.col("node")), block))))
    hot = settled(members.where(large).drop("n", "g"))
    if hot.isEmpty():
        return found

    def widened(more: DataFrame) -> DataFrame | None:
        more = settled(more)
        if more.isEmpty():
            return None
        return settled(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    for turn in range(3):  # heads of components, until a group has one or no more of them meet
        heads = marked(hot, found).groupBy("key", "component").agg(F.min_by(F.struct(*hot.columns), "node").alias("head"))
        heads = settled(heads.select("head.*", "component"))
        counts = settled(heads.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("grams").alias("g")).where("c > 1"))
        if counts.isEmpty():
            return found
        deal = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.greatest(F.col("c") / BLOCK, F.col("g") / GRAMS)))
        more = widened(link(within(heads.join(small(counts), "key"), deal)))
        if more is None:
            break
        found = more
    hot = marked(hot, found)
    split = settled(split_groups(hot))
    if split.isEmpty():
        return found
    return widened(link(block_pairs(hot, small(split)))) or found


def families(signed: DataFrame) -> DataFrame:
    """signed (node, bands, marks, weight, grams) -> node, component: texts joined by likely links within buckets."""
    exploded = signed.select("node", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a signature is as large for any text, so only the number of texts bounds a block
    buckets = exploded.join(shared, "key").join(signed.select("node", "marks", "weight", F.lit(0).alias("grams")), "node")
    return resolved(buckets, F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK), likely_links)


def one_text_each(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes, once each."""
    return texts.join(small(wanted.select("node")), "node", "left_semi").select("node", "text").dropDuplicates(["node"])


def text_node(text: Column) -> Column:
    return F.xxhash64(F.sha2(F.coalesce(text, F.lit("")), 256))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(ids, merged, path): doc_id and node of every row; of each node that shares its class, class_id, class_size and ``first``, the class's first node.

    The first node of a class holds the row with the smallest doc_id, rows without one last; of several,
    it is the smallest. ``path`` is a folder that the caller removes when both have been used.
    """
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "near")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", text_node(F.col("text")))
    texts.select("doc_id", "node").write.parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    n = ids.count()
    weights = Weights(frequent_shingles(texts, n), n)

    signatures(texts, weights).write.parquet(f"{path}/signatures")
    signed = spark.read.parquet(f"{path}/signatures")
    family = families(signed).withColumnRenamed("component", "key")
    sizes = settled(family.join(signed.select("node", "grams"), "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("g")).where((F.col("n") > BLOCK) | (F.col("g") > GRAMS)))
    placed = family.join(small(sizes), "key", "left").join(signed.select("node", "weight", "grams"), "node")
    one_text_each(texts, family).join(placed, "node").write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    blocks = F.coalesce(F.ceil(F.greatest(F.col("n") / BLOCK, F.col("g") / GRAMS)), F.lit(1))
    found = resolved(members, F.col("n").isNotNull(), blocks, lambda rows: similar_links(rows, weights))

    rows = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).join(found, "node", "left")
    rows = settled(rows.where(F.col("component").isNotNull() | (F.col("n") > 1)).withColumn("component", F.coalesce("component", "node")))
    of = rows.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("top"))
    merged = settled(rows.select("node", "component").join(of, "component").select("node", "class_id", "class_size", F.col("top.node").alias("first")))
    return ids, merged, path


def groups(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, class_id (the class's smallest doc_id), class_size, one row per document."""
    ids, merged, path = classes(docs)
    rows = ids.join(small(merged.select("node", "class_id", "class_size")), "node", "left")
    alone = F.col("class_size").isNull()
    out = settled(rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size")))
    remove(docs.sparkSession, path)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns: of its first node's rows with the class's id, the smallest in all columns."""
    _, merged, path = classes(docs)
    node, least, first = (unused(docs, name) for name in ("node", "class_id", "first"))
    marked_docs, firsts = docs.withColumn(node, text_node(F.col("text"))), merged.where("node = first").select(F.col("node").alias(node), F.col("class_id").alias(least))
    alone = marked_docs.join(small(merged.select(F.col("node").alias(node))), node, "left_anti").select(*docs.columns)
    rows = marked_docs.join(small(firsts), node).where(same(F.col("doc_id"), F.col(least)))
    rows = rows.groupBy(node).agg(F.min(F.struct(*docs.columns)).alias(first)).select(f"{first}.*")
    remove(docs.sparkSession, path)
    return alone.unionByName(rows)
