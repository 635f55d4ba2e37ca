"""Word shingles of texts, hashed with numpy, and the inverse document frequency of the frequent ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criterium.llm.common import lean

WORDS = 5
#: Shingles on more than this share of all documents weigh less; none weighs less than ``FLOOR`` of a rare one.
FREQUENT, FLOOR = 0.01, 0.5
#: A text is hashed in slices of so many bytes, cut before a word.
SLICE = 1 << 16
#: Counters of a task's summary of frequent shingles; distinct shingles that are gathered before they enter it.
COUNTERS, GATHERED = 1 << 17, 500_000

U = np.uint64
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_INSIDE[128:] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[32] = False
_LETTER = np.random.default_rng(17).integers(1, 2**64, 256, dtype=U)
_ODD, _MIX = 0x9E3779B97F4A7C15, U(0xD1B54A32D192ED03)
#: Factors of the words of a run, by its length and their place; the longest run.
LONGEST = 8
_PLACE = np.random.default_rng(18).integers(0, 2**63, (LONGEST + 1, LONGEST), dtype=U) * U(2) + U(1)


def _powers(base: int) -> np.ndarray:
    found = np.full(SLICE, U(base))
    found[0] = U(1)
    return np.multiply.accumulate(found)


_UP, _DOWN = _powers(_ODD), _powers(pow(_ODD, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * _MIX
    return h ^ (h >> U(32))


def _slice_hashes(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A hash of each word of at most ``SLICE`` bytes: a polynomial of its letters, from running sums."""
    inside = np.zeros(len(data) + 2, bool)
    letters.take(data, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_LETTER.take(data) * _UP[: len(data)], out=sums[1:])
    return _mixed((sums.take(end) - sums.take(begin)) * _DOWN.take(begin))


def _hashes(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    if len(data) < SLICE:
        return _slice_hashes(data, letters)
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        outside = np.flatnonzero(~letters[data[at:end]])
        if len(outside):
            end = at + int(outside[-1]) + 1 if end < len(data) else len(data)
            parts.append(_slice_hashes(data[at:end], letters))
        elif end > len(data):
            end = len(data)
            parts.append(_slice_hashes(data[at:end], letters))
        else:  # a word of a whole slice and more
            while end < len(data) and letters[data[end : end + SLICE]].all():
                end += SLICE
            if end < len(data):
                end += int(np.argmin(letters[data[end : end + SLICE]]))
            end = min(end, len(data))
            parts.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes())], U))
        at = end
    return np.concatenate(parts)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, in order. Words are runs of ASCII letters, digits and all other than ASCII, in lower case."""
    return _hashes(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8), _INSIDE)


def spaced_hashes(text: str) -> np.ndarray:
    """64-bit hashes of what stands between spaces, in order."""
    return _hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), _NOT_SPACE)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes, n up to ``LONGEST``."""
    m = len(h) - n + 1
    mixed = h[:m] * _PLACE[n, 0]
    for k in range(1, n):
        mixed += h[k : k + m] * _PLACE[n, k]
    return mixed


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes ascending, counts); a text of fewer than ``WORDS`` words is one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h, np.empty(0, np.int64)
    mixed = run_hashes(h, min(WORDS, len(h)))
    m = len(mixed)
    mixed.sort()
    new = np.empty(m + 1, bool)
    new[0] = new[m] = True
    np.not_equal(mixed[1:], mixed[:-1], out=new[1:m])
    first = np.flatnonzero(new)
    return mixed.take(first[:-1]), first[1:] - first[:-1]


class Weights:
    """Count times inverse document frequency, idf(df) = ln(documents / df) / ln(1 / FREQUENT), between ``FLOOR`` and 1."""

    def __init__(self, frequent: dict[int, int], n: int):
        self.hashes = np.array(sorted(frequent), U)
        df = np.array([frequent[int(h)] for h in self.hashes], float)
        self.idf_of = np.clip(np.log(max(n, 1) / np.maximum(df, 1)) / math.log(1 / FREQUENT), FLOOR, 1)

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        w = np.ones(len(hashes))
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            w[hit] = self.idf_of[at[hit]]
        return w

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf(hashes)


class Summary:
    """Counters of what is frequent in a stream: a count is short of the true one by at most ``short`` (frequent-items summary, mergeable)."""

    def __init__(self, size: int):
        self.size, self.short = size, 0
        self.keys, self.counts = np.empty(0, U), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if not len(keys):
            return
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.size:
            cut = int(np.partition(counts, len(counts) - self.size - 1)[len(counts) - self.size - 1])
            counts = counts - cut
            keys, counts = keys[counts > 0], counts[counts > 0]
            self.short += cut
        self.keys, self.counts = keys, counts

    def row(self) -> pa.RecordBatch:
        return pa.record_batch([[self.keys.tobytes()], [self.counts.tobytes()], pa.array([self.short], pa.int64())], names=["keys", "counts", "short"])


SUMMARY = "keys binary, counts binary, short long"


def _merge(size: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, any_rows = Summary(size), False
        for batch in batches:
            for keys, counts, short in zip(*(batch.column(k) for k in range(3))):
                any_rows = True
                summary.short += short.as_py()
                summary.add(np.frombuffer(keys.as_buffer(), U), np.frombuffer(counts.as_buffer(), np.int64))
        if any_rows:
            yield summary.row()

    return merge


def _candidates(texts: DataFrame, n: int, counters: int) -> np.ndarray:
    """Hashes among which all shingles on more than ``FREQUENT`` of the n texts are; no more than the summary's counters."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, held, size = Summary(counters), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingles(text.as_py())[0])
                size += len(held[-1])
                if size > GATHERED:
                    summary.add(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            summary.add(*np.unique(np.concatenate(held), return_counts=True))
        if len(summary.keys):
            yield summary.row()

    rows = texts.select("text").mapInArrow(lean(name), SUMMARY)
    for parts in (64, 1):  # each is smaller than the counters, so these tasks are bounded
        rows = rows.repartition(parts).mapInArrow(lean(_merge(counters)), SUMMARY)
    found = rows.first()
    if found is None:
        return np.empty(0, U)
    keys, counts = np.frombuffer(bytes(found["keys"]), U), np.frombuffer(bytes(found["counts"]), np.int64)
    if found["short"] > FREQUENT * n:  # long texts: more counters are needed to be sure of every one
        return _candidates(texts, n, 4 * counters)
    return keys[counts + found["short"] > FREQUENT * n]


def frequent_shingles(texts: DataFrame, n: int) -> dict[int, int]:
    """Document frequencies, over all n rows of ``texts`` (text), of the shingles on more than ``FREQUENT`` of them.

    Every task summarises its shingles in a bounded number of counters, summaries are merged, and what
    may be frequent is then counted exactly. So the result does not depend on how the rows are dealt, and
    at most 1 / ``FREQUENT`` times the mean number of shingles of a text reach the driver.
    """
    named = np.sort(_candidates(texts, n, COUNTERS))
    if not len(named):
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(named), np.int64)
        for batch in batches:
            for text in batch.column(0):
                h = shingles(text.as_py())[0]
                if len(h):
                    at = np.minimum(np.searchsorted(named, h), len(named) - 1)
                    counts[at[named[at] == h]] += 1
        hit = counts > 0
        if hit.any():
            yield pa.record_batch([named[hit].view(np.int64), counts[hit]], names=["shingle", "n"])

    counts = texts.select("text").mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT * n)
    return {r["shingle"] % 2**64: r["n"] for r in counts.toLocalIterator()}
