"""Token ids in files of fixed-width bit-packed blocks.

A dataset is a folder of shards in ascending document order and an ``index.json``. A shard holds
blocks of ``BLOCK`` ids, each id in ``width`` bits (the fewest that hold the vocabulary), least
significant bit first, each block padded to whole bytes; then a footer:

    offsets  u64 x (blocks + 1)   where each block begins, and where the last ends
    docs     i64 x documents      document ids
    ends     u64 x documents      ids of the shard up to and with each document's last
    nulls    u8  x documents      1 where the document id is null
    tail     "<8sIIQQQ"           magic, width, block length, blocks, documents, ids

``index.json`` lists the shards, each with the number of ids before it. A reader unpacks whole
blocks with numpy and reaches any document through the block offsets.

Writers put each shard under a name of its own and only the index makes it count, so a task that
runs again (lost executor, speculation) leaves no double. Defined cases: a null or empty text is
the end id alone; documents with the same id stand next to each other, by text; an empty table
gives an index without shards.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from criterium.llm.common import lean

MAGIC = b"IDPACK01"
TAIL = "<8sIIQQQ"
BLOCK = 4096
NATIVE = {8: "u1", 16: "<u2", 32: "<u4"}


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in NATIVE:
        return ids.astype(NATIVE[width]).tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype="<u4")) & 1
    return np.packbits(bits.astype("u1").ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in NATIVE:
        return np.frombuffer(data, NATIVE[width], n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, "u1"), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("<u4") << np.arange(width, dtype="<u4")).sum(axis=1, dtype="<u4")


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Streams blocks out; holds one block and the document index in memory."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.docs, self.ends, self.offsets, self.open, self.held, self.n = [], [], [0], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.open.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.docs.append(doc_id)
        self.ends.append(self.n)
        if self.held >= BLOCK:
            whole = np.concatenate(self.open)
            for k in range(0, len(whole) - BLOCK + 1, BLOCK):
                self._put(whole[k : k + BLOCK])
            rest = whole[len(whole) // BLOCK * BLOCK :]
            self.open, self.held = [rest], len(rest)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.open))
        self.sink.write(np.asarray(self.offsets, "<u8").tobytes())
        self.sink.write(np.asarray([d or 0 for d in self.docs], "<i8").tobytes())
        self.sink.write(np.asarray(self.ends, "<u8").tobytes())
        self.sink.write(bytes(d is None for d in self.docs))
        self.sink.write(struct.pack(TAIL, MAGIC, self.width, BLOCK, len(self.offsets) - 1, len(self.docs), self.n))


class ShardReader:
    """``source`` is a seekable file of pyarrow."""

    def __init__(self, source):
        self.source, size, tail = source, source.size(), struct.calcsize(TAIL)
        magic, self.width, self.block, blocks, docs, self.n = struct.unpack(TAIL, source.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        at = size - tail - docs
        nulls = np.frombuffer(source.read_at(docs, at), "u1")
        self.ends = np.frombuffer(source.read_at(8 * docs, at - 8 * docs), "<u8").astype("i8")
        ids = np.frombuffer(source.read_at(8 * docs, at - 16 * docs), "<i8")
        self.docs = [None if x else int(d) for d, x in zip(ids, nulls)]
        self.offsets = np.frombuffer(source.read_at(8 * (blocks + 1), at - 16 * docs - 8 * (blocks + 1)), "<u8").astype("i8")

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids of the shard from ``begin`` to ``end``; reads the blocks that hold them."""
        if begin >= end:
            return np.empty(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            lo, hi = self.offsets[b] - self.offsets[first], self.offsets[b + 1] - self.offsets[first]
            parts.append(unpack(data[lo:hi], self.width, min(self.block, self.n - b * self.block)))
        return np.concatenate(parts)[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_ids(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 0) -> list[dict]:
    """Tokenise ``docs`` (doc_id, text) and write a dataset at ``path``; returns the index.

    One range shuffle of the texts by doc_id; each task streams its documents into one shard. The
    driver sees one small row per shard.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from criterium.llm.tokens import encoder

        fs, folder = file_system(path)
        part, name, writer, coder = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids", None, encoder(tokenizer, 96 << 20)
        for batch in batches:
            texts = (text.as_py() for text in batch.column(1))
            for doc_id, data in zip(batch.column(0).to_pylist(), coder.encode_all(texts)):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(out, width_of(max(coder.vocabulary, end_id + 1)))
                writer.add(doc_id, np.append(np.frombuffer(data, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([[part], [name], [len(writer.docs)], [writer.n]], schema=SHARD)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index, start = [], 0
    for r in sorted(rows.mapInArrow(lean(shard), "part long, name string, docs long, ids long").collect()):
        index.append({"name": r["name"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/index.json") as f:
        f.write(json.dumps({"shards": index, "ids": start}).encode())
    return index


SHARD = pa.schema([("part", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a dataset: doc_id, start, n_tokens, ids_crc32, from the unpacked ids."""
    fs, folder = file_system(path)
    with fs.open_input_file(f"{folder}/index.json") as f:
        shards = json.loads(f.read())["shards"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    shard = ShardReader(f)
                    for lo in range(0, len(shard.docs), 2000):
                        rows = []
                        for k in range(lo, min(lo + 2000, len(shard.docs))):
                            ids = shard.document(k)
                            rows.append((shard.docs[k], start + int(shard.ends[k]) - len(ids), len(ids), zlib.crc32(ids.tobytes())))
                        yield pa.record_batch([list(c) for c in zip(*rows)], schema=DIGEST)

    listed = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long")
    return listed.repartition(max(1, len(shards)), "name").mapInArrow(lean(digests), "doc_id long, start long, n_tokens long, ids_crc32 long")
