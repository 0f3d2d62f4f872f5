"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of documents in order. Ids are cut into blocks; a block stores its smallest id, the differences to
it packed at the width that a given share of them fits in, and the few wider ones whole in an exception list. An index
of block starts gives random access. Layout, little-endian: blocks | block starts (u64, one more than blocks) | document
ids (i64) | 1 where the document id is null (u8) | end of each document in ids (u64) | footer ``_FOOTER``.
Block: smallest (u32), ids (u32), exceptions (u32), width (u8) | packed | exception places (u32) | exceptions (u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens, words
from tidemark.llm.files import mapped, put, settled, shared_folder

BLOCK = 4096
#: Share of a block's differences that fit in its width.
FITTING = 0.95
#: Bytes of text in a file, about.
FILE_BYTES = 1 << 26

_HEAD = struct.Struct("<IIIB")
_FOOTER = struct.Struct("<QQQQI8s")  # blocks, documents, ids, where the block starts begin, block size, magic
_MAGIC = b"PFORIDS1"


def encode_block(ids: np.ndarray, fitting: float = FITTING) -> bytes:
    low = ids.min()
    delta = (ids - low).astype("<u4")
    bits = np.frexp(delta.astype(np.float64))[1]
    width = int(np.partition(bits, k := min(len(bits) - 1, int(fitting * len(bits))))[k])
    wide = np.flatnonzero(bits > width).astype("<u4")
    unpacked = np.unpackbits(delta.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(unpacked.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(int(low), len(ids), len(wide), width) + packed + wide.tobytes() + delta[wide].tobytes()


def decode_block(data: np.ndarray) -> np.ndarray:
    low, n, exceptions, width = _HEAD.unpack(data[: _HEAD.size].tobytes())
    end = _HEAD.size + (n * width + 7) // 8
    bits = np.zeros((n, 32), dtype=np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(data[_HEAD.size : end], count=n * width, bitorder="little").reshape(n, width)
    delta = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    places = data[end : end + 4 * exceptions].tobytes()
    values = data[end + 4 * exceptions : end + 8 * exceptions].tobytes()
    delta[np.frombuffer(places, dtype="<u4")] = np.frombuffer(values, dtype="<u4")
    return delta + np.uint32(low)


class Writer:
    """Feeds documents, one batch after the other, into the bytes of one file."""

    def __init__(self, block: int = BLOCK):
        self.block, self.rest = block, np.zeros(0, dtype=np.uint32)
        self.starts, self.size, self.ids = [0], 0, 0
        self.doc_ids: list[int | None] = []
        self.ends: list[np.ndarray] = []

    def _blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), self.block):
            block = encode_block(ids[at : at + self.block])
            self.size += len(block)
            self.starts.append(self.size)
            yield block

    def add(self, doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        self.doc_ids.extend(doc_ids)
        self.ends.append(self.ids + bounds[1:])
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        self.rest = ids[whole:].copy()
        yield from self._blocks(ids[:whole])

    def close(self) -> Iterator[bytes]:
        yield from self._blocks(self.rest)
        yield np.array(self.starts, dtype="<u8").tobytes()
        yield np.array([0 if d is None else d for d in self.doc_ids], dtype="<i8").tobytes()
        yield np.array([d is None for d in self.doc_ids], dtype=np.uint8).tobytes()
        yield (np.concatenate(self.ends) if self.ends else np.zeros(0)).astype("<u8").tobytes()
        yield _FOOTER.pack(len(self.starts) - 1, len(self.doc_ids), self.ids, self.size, self.block, _MAGIC)


class Reader:
    """Random access to a file's documents and ids, over a memory map."""

    def __init__(self, path: str):
        self.data = mapped(path)
        blocks, docs, self.n_ids, at, self.block, magic = _FOOTER.unpack(self.data[-_FOOTER.size :].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token-id file")

        def part(count: int, kind: str) -> np.ndarray:
            nonlocal at
            at, start = at + count * np.dtype(kind).itemsize, at
            return np.frombuffer(self.data[start:at].tobytes(), dtype=kind)

        self.starts = part(blocks + 1, "<u8").astype(np.int64)
        self.doc_ids, null = part(docs, "<i8"), part(docs, "u1")
        self.null = null.astype(bool)
        self.ends = part(docs, "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``; only their blocks are read."""
        first, last = start // self.block, -(-stop // self.block)
        found = [decode_block(self.data[self.starts[b] : self.starts[b + 1]]) for b in range(first, last)]
        if not found:
            return np.zeros(0, dtype=np.uint32)
        return np.concatenate(found)[start - first * self.block : stop - first * self.block]

    def runs(self, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, int]]:
        """First and last document of each run of about ``most`` ids, its ids, and the ids before it."""
        first, begin = 0, 0
        while first < len(self.ends):
            last = max(first + 1, int(np.searchsorted(self.ends, begin + most, side="right")))
            stop = int(self.ends[last - 1])
            yield first, last, self.ids(begin, stop), begin
            first, begin = last, stop


def write(docs: DataFrame, end: int, folder: str | None = None, path: str = tokens.VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ids of ``docs`` (doc_id, text), each document's with ``end``, to files in ascending doc_id order.

    Returns (shard, path, n_docs, n_ids), a row per file; shard order is document order. Null ids come first, rows that
    share an id are ordered by a hash of their text. Null texts are empty. A repeated task replaces its file.
    """
    folder = folder or shared_folder(docs.sparkSession, "ids")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ordered = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, coder = TaskContext.get().partitionId(), Writer(), tokens.encoder(path)
        name = f"{folder}/shard-{shard:09d}.ids"

        def chunks() -> Iterator[bytes]:
            for batch in words.pieces(batches, "text", 1 << 22):
                yield from writer.add(batch.column("doc_id").to_pylist(), *coder.encode(batch.column("text"), end))
            yield from writer.close()

        put(name, chunks())
        row = [[shard], [name], [len(writer.doc_ids)], [writer.ids]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = [pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "n_docs", "n_ids"])

    files = ordered.select("doc_id", "text").mapInArrow(store, "shard int, path string, n_docs long, n_ids long")
    return settled(files, "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, decoded from the files of ``manifest``.

    ``start`` counts the ids of all documents before; the running sum is over one row per file.
    """
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.where("n_docs > 0").withColumn("first", F.coalesce(before, F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, offset in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "first")), strict=True):
                reader = Reader(path)
                for first, last, ids, begin in reader.runs():
                    ends = reader.ends[first:last]
                    starts = np.concatenate([[begin], ends[:-1]])
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(starts, ends, strict=True)]
                    doc = pa.array(reader.doc_ids[first:last], mask=reader.null[first:last])
                    columns = [doc, pa.array(offset + starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([shard] * len(doc), pa.int32())], names)

    # A task a file: without a number, adaptive execution would merge these small rows into one task.
    spread = files.select("shard", "path", "first").repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
