"""Packing of documents into training sequences by length patterns fitted with non-negative least squares.

Patterns of a few length bins that together fill a sequence are enumerated, and their repeat counts are fitted to the
histogram of all lengths. The counts are rounded down, shared out over the parts of the table, and carried out there
with real documents; what is left over is packed best-fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens, words
from tidemark.llm.files import settled, shielded

SEQUENCE = 4096
#: Length bins of the patterns, and documents in a pattern at most.
BINS, DEPTH = 64, 5
#: Pieces packed in one task, about.
PART = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, end: int, sequence: int = SEQUENCE, path: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``end``, cut where longer than a sequence."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        for batch in words.pieces(batches, "text", 1 << 22):
            ids, bounds = coder.encode(batch.column("text"), end)
            size = np.diff(bounds)
            parts = -(-size // sequence)
            row = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * sequence
            length = np.minimum(sequence, size[row] - start)
            raw = memoryview(ids.astype("<u4")).cast("B")
            begin = 4 * (bounds[row] + start)
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(begin, length, strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _PIECES)


def patterns(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Bins per pattern (rows), by how often a pattern holds each: bins whose middles fill a sequence, not more."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, parts: int) -> None:
        if parts == 1:
            if 0 <= left <= (head[-1] if head else bins - 1):
                found.append((*head, left))
            return
        for b in range(min(left, head[-1] if head else bins - 1), -(-left // parts) - 1, -1):
            grow((*head, b), left - b, parts - 1)

    for k in range(1, depth + 1):
        grow((), bins - (k + 1) // 2, k)
    out = np.zeros((len(found), bins), dtype=np.float64)
    for row, pattern in zip(out, found, strict=True):
        np.add.at(row, list(pattern), 1)
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the smallest |a x - b|, by active sets; at most as many of x are positive as ``a`` has rows."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[on] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= scale:
            break
        on[best] = True
        while True:
            at = np.flatnonzero(on)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            x[at[low & (x[at] <= 1e-12)]] = 0
            on &= x > 1e-12
            if not on.any():
                break
    return x


def fitted(histogram: np.ndarray, bins: int = BINS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Patterns in use and their repeat counts. A missing long document weighs more than a short one."""
    a = patterns(bins, depth)
    weight = np.arange(bins) + 0.5
    x = least_squares((a * weight).T, histogram * weight)
    return a[x > 0], x[x > 0]


class Pool:
    """Items by exact length; the longest that fits is found by bisection."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        self.by: dict[int, list[int]] = {}
        for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
            self.by.setdefault(n, []).append(i)
        self.lengths = sorted(self.by)

    def take(self, most: int, least: int) -> tuple[int, int] | None:
        """An item of the greatest length from ``least`` to ``most``, and its length."""
        at = bisect_right(self.lengths, most) - 1
        if at < 0 or self.lengths[at] < least:
            return None
        n = self.lengths[at]
        item = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[at]
        return item, n

    def put_back(self, item: int, n: int) -> None:
        if n not in self.by:
            self.by[n] = []
            insort(self.lengths, n)
        self.by[n].append(item)


def pack(lengths: np.ndarray, shapes: np.ndarray, repeats: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every item of one part."""
    pool, width = Pool(lengths), sequence / shapes.shape[1]
    place, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []

    def put(number: int, item: int, n: int) -> None:
        place[item], offset[item] = number, used[number]
        used[number] += n

    for shape, n in zip(shapes, repeats.tolist(), strict=True):
        bins = [b for b in np.flatnonzero(shape)[::-1].tolist() for _ in range(int(shape[b]))]
        for _ in range(n):
            taken, left = [], sequence
            for k, b in enumerate(bins):
                low, high = int(b * width) + 1, int((b + 1) * width)
                # The last document is the one that fills the sequence best; it may lie in a bin next to its own.
                last = k == len(bins) - 1
                got = pool.take(min(left, sequence if last else high), int(max(1, low - width)) if last else low)
                if got is None:
                    break
                taken.append(got)
                left -= got[1]
            if len(taken) < len(bins):  # the part has no such documents left
                for item in taken:
                    pool.put_back(*item)
                break
            used.append(0)
            for item in taken:
                put(len(used) - 1, *item)
    free = sorted((sequence - u, i) for i, u in enumerate(used) if u < sequence)
    while (got := pool.take(sequence, 1)) is not None:  # best fit, longest first
        item, n = got
        at = bisect_right(free, (n, -1))
        if at < len(free):
            left, number = free.pop(at)
        else:
            used.append(0)
            left, number = sequence, len(used) - 1
        put(number, item, n)
        if left > n:
            insort(free, (left - n, number))
    return place, offset


def packed(pieces: DataFrame, sequence: int = SEQUENCE, part: int = PART) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``sequence``) with ``sequence_id`` and ``offset``; a row for each row.

    The histogram has ``BINS`` rows whatever the input. Parts are drawn by a hash of the row's place in the written
    table, so that equal pieces spread; each part packs alone and leaves about one sequence unfilled. An empty table
    gives an empty one. Extra columns stay; ``sequence_id`` and ``offset`` are replaced if they exist.
    """
    rows, inner = shielded(settled(pieces.drop("sequence_id", "offset"), "pieces"))
    length = F.col(inner["length"])
    counts = {r.b: r.n for r in rows.groupBy(F.floor((length - 1) * BINS / sequence).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    shapes, repeats = fitted(np.array([counts.get(b, 0) for b in range(BINS)], dtype=float))
    parts = max(1, -(-total // part))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]

    def pack_part(table: pa.Table) -> pa.Table:
        share = np.floor(repeats * table.num_rows / max(1, total)).astype(np.int64)
        place, offset = pack(table.column(inner["length"]).to_numpy(), shapes, share, sequence)
        number = table.column("_part")[0].as_py() * (1 << 32) + place
        table = table.drop_columns(["_part"])
        return table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))
    schema = ", ".join([*names, "sequence_id long", "offset long"])
    packed_ = rows.withColumn("_part", drawn).groupBy("_part").applyInArrow(pack_part, schema)
    return packed_.toDF(*inner, "sequence_id", "offset")
