"""Best-fit-decreasing packing of documents into sequences of at most ``capacity`` tokens.

The ids of a document are cut into pieces of ``capacity`` from its end, so that only the first
piece may be shorter. Pieces of one length are interchangeable, and so are open bins with the same
room. The exact global best-fit decreasing packing therefore follows from the histogram of piece
lengths alone, at most ``capacity`` numbers, however many documents there are: the driver walks the
lengths downwards, finds the tightest room that fits in a segment tree over remaining capacities,
and deals out whole runs of pieces at once. The result is a plan of segments (length, first rank,
bins, pieces a bin, offset); each piece looks its rank among the pieces of its length up in it.

Defined cases: a null or empty text is its end id alone; documents with the same id are packed
each; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criterium.llm.common import claim, lean, ranked, settled

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'double' if f.type == pa.float64() else 'long'}" for f in schema)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


class RoomTree:
    """A segment tree over remaining capacities; a leaf counts the open bins with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        k = room + self.size
        while k:
            self.sums[k] += bins
            k //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that an open bin has."""
        k = length + self.size
        if not self.sums[k]:
            while k > 1 and (k & 1 or not self.sums[k + 1]):
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.sums[2 * k] else 2 * k + 1
        return k - self.size


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Returns segments (length, first rank, first bin, pieces a bin, offset in the bin), by length
    and rank, and the number of bins. A run of bins with the same room is dealt with at once.
    """
    tree, runs, segments, bins = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n = bins, -(-left // each)
                bins += n
                room = capacity
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
                each = room // length
            used = min(n, left // each)
            if used:
                segments.append((length, rank, first, each, capacity - room))
                rank, left = rank + used * each, left - used * each
                _open(tree, runs, room - used_room(each, length), first, used)
            if used < n:
                if left:
                    segments.append((length, rank, first + used, left, capacity - room))
                    _open(tree, runs, room - used_room(left, length), first + used, 1)
                    rank, left, used = rank + left, 0, used + 1
                if used < n:
                    _open(tree, runs, room, first + used, n - used)
    return sorted(segments), bins


def used_room(pieces: int, length: int) -> int:
    return pieces * length


def _open(tree: RoomTree, runs: dict, room: int, first: int, bins: int) -> None:
    if room:
        runs.setdefault(room, []).append((first, bins))
        tree.add(room, bins)


def pieces(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, group: int = 0, kept: int = 64 << 20) -> DataFrame:
    """doc_id, text -> one row per piece, without its ids: doc_id, piece, start, length, ids_crc32.

    Texts are encoded together up to ``group`` characters, each alone if that is 0; a worker keeps up to ``kept`` bytes
    of chunks twice. More of either takes memory for CPU, and no id depends on them.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from criterium.llm.tokens import encoder

        coder, last = encoder(tokenizer, kept), end_id.to_bytes(4, "little")
        for batch in batches:
            rows, texts = [], (text.as_py() for text in batch.column(1))
            for doc_id, found in zip(batch.column(0).to_pylist(), coder.encode_all(texts, group) if group else map(coder.encode, texts)):
                ids = found + last
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=PIECE)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(cut_up), ddl(PIECE))


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, group: int = 0, kept: int = 64 << 20) -> DataFrame:
    """doc_id, text -> pieces with sequence_id and offset. Only a histogram of lengths reaches the driver."""
    cuts = ranked(settled(pieces(docs, capacity=capacity, tokenizer=tokenizer, end_id=end_id, group=group, kept=kept)), ["length"], ["doc_id", "piece", "ids_crc32"])
    counts = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}
    segments, _ = plan(counts, capacity)
    by_length: dict[int, tuple[list, list]] = {}
    for length, rank, *rest in segments:
        ranks, to = by_length.setdefault(length, ([], []))
        ranks.append(rank)
        to.append(rest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("places", lambda: None)
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                ranks, to = by_length[length]
                k = bisect_right(ranks, rank) - 1
                first, each, offset = to[k]
                sequences.append(first + (rank - ranks[k]) // each)
                offsets.append(offset + (rank - ranks[k]) % each * length)
            yield pa.record_batch([*(batch.column(f.name) for f in PIECE), sequences, offsets], schema=PLACED)

    return cuts.mapInArrow(lean(place), ddl(PLACED))
