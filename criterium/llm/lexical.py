"""Ranked lexical search: a blocked sparse matrix product of items x terms and terms x documents.

The left matrix holds how often an item has a term, the right one the int64 impact of a term in a document.
Items are cut by hash into blocks of about ``OCCURRENCES`` term occurrences, so the left block that a task holds
is bounded, whatever the number of items. For a block of items, a first pass over the texts writes, as
columns of the right matrix before its weights, the counts of the block's terms in every document, whose totals
give document frequencies. A second pass takes these columns Arrow batch by Arrow batch: a batch is turned into
rows by term with numpy, an item's row of the product is the merger of its terms' rows (Gustavson), and of
every row the ``k`` best stay, batch after batch, so a task gives out ``k`` documents an item at most and only
these are shuffled. No text and no count is shuffled, so no source, term or group of copies is hot.

Terms are runs of letters (A-Z as a-z), digits and all other than ASCII.

Defined cases: a null or empty text has no terms, and an item without terms finds nothing; rows are documents and
items of their own, so repeated ones each count and each get ranks; of equal scores the smaller doc_id comes first,
null last; without documents there are no rows; very long texts are counted whole; other columns are left aside.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from criterium.llm.common import fresh_path, lean, remove, settled

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Term occurrences in a block of items.
OCCURRENCES = 1_000_000

# In UTF-8 all bytes of other letters are above ASCII, so bytes can be told apart one by one.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


@dataclass
class Items:
    """A block of the left matrix: row i has ``terms[starts[i]:starts[i + 1]]``, ``times`` each; ``ids`` names the rows."""

    vocabulary: list[bytes]
    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Items:
        """From (item, term, times)."""
        rows = rows.combine_chunks()
        words = rows["term"].combine_chunks().dictionary_encode()
        item = rows["item"].to_numpy()
        order = np.argsort(item, kind="stable")
        ids, starts = np.unique(item[order], return_index=True)
        return cls([w.encode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()], ids, np.append(starts, len(item)), words.indices.to_numpy()[order], rows["times"].to_numpy()[order])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]).astype(np.int32)))


def _counted(vocabulary) -> Callable:
    """mapInArrow: (doc_id, text) -> the columns of the documents that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(vocabulary.value)}.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, sizes, terms, counts = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    found = terms_of(text.as_py())
                    if found:
                        held = Counter(map(place, found))
                        held.pop(None, None)
                        ids.append(doc_id)
                        sizes.append(len(found))
                        terms.append(np.fromiter(held.keys(), np.int32, len(held)))
                        counts.append(np.fromiter(held.values(), np.int32, len(held)))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(terms), _lists(counts)], schema=_COUNTS)

    return lean(run)


class Best:
    """The ``k`` best (score, doc) of every item so far; smaller places of ``doc`` first among equals."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def least(self, item: int) -> int:
        """What a score must reach to matter."""
        kept = self.of.get(item)
        return int(kept[0][-1]) if kept is not None and len(kept[0]) == self.k else 1

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        if item in self.of:
            score, doc, null = (np.concatenate(x) for x in zip(self.of[item], (score, doc, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.of[item] = score[order], doc[order], null[order]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        items = [np.full(len(s), ids[i]) for i, (s, _, _) in self.of.items()]
        score, doc, null = (np.concatenate([*(x[c] for x in self.of.values()), np.zeros(0, np.int64)]) for c in range(3))
        return pa.record_batch([pa.array(np.concatenate([*items, np.zeros(0)]).astype(np.int64)), pa.array(doc.astype(np.int64), mask=null.astype(bool)), pa.array(score.astype(np.int64))], schema=_FOUND)


def _product(block, weights: np.ndarray, documents: int, occurrences: int, k: int) -> Callable:
    """mapInArrow: columns of the right matrix -> the task's best documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        best = Best(k)
        for batch in batches:
            n_docs = batch.num_rows
            if not n_docs:
                continue
            doc, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            m = 100 - 75 + (75 * batch.column(1).to_numpy() * documents) // occurrences
            lists, tf = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            term = lists.flatten().to_numpy()
            at = np.repeat(np.arange(n_docs, dtype=np.int32), lists.value_lengths().to_numpy())
            order = np.argsort(term, kind="stable")
            term, tf, at = term[order], tf[order], at[order]
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
            first = np.searchsorted(term, np.arange(len(weights) + 1))
            row = np.zeros(n_docs, np.int64)
            for i in range(len(items.ids)):
                row[:] = 0
                for e in range(items.starts[i], items.starts[i + 1]):
                    a, b = first[items.terms[e]], first[items.terms[e] + 1]
                    row[at[a:b]] += items.times[e] * impact[a:b]  # a term has a document once
                hit = np.flatnonzero(row >= best.least(i))
                if len(hit) > 4 * k:
                    hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
                if len(hit):
                    best.add(i, row[hit], doc[hit], null[hit].astype(np.int64))
        yield best.rows(items.ids)

    return lean(run)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, occurrences: int = OCCURRENCES) -> DataFrame:
    """documents (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score: every item's ``k`` best documents."""
    spark = docs.sparkSession
    rows = settled(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0)).alias("terms")))
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // occurrences)
    left = rows.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    found = []
    for block in range(blocks):
        # one block's occurrences, of which there are about as many as the parameter says
        own = Items.of(left.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow())
        if not len(own.ids):
            continue
        path = fresh_path(spark, "lexical")
        vocabulary, held = spark.sparkContext.broadcast(own.vocabulary), spark.sparkContext.broadcast(own)
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        texts.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, counts array<int>").write.option("compression", "zstd").parquet(path)
        columns = spark.read.parquet(path)
        n, every = columns.agg(F.count(F.lit(1)), F.sum("n")).first()
        frequency = np.zeros(len(own.vocabulary), np.int64)
        for r in columns.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # one row a term of the block
            frequency[r["term"]] = r["count"]
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * frequency + 1))).astype(np.int64)
        if n:
            found.append(settled(_ranked(columns.mapInArrow(_product(held, weights, n, every, k), "item long, doc_id long, score long"), k)))
        remove(spark, path)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return candidates.withColumn("rank", place).where(F.col("rank") <= k)
