"""Words, their hashes and shingles of whole Arrow text columns, vectorised over the raw UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and return
(``[^\\x20\\x09-\\x0D]+``; these bytes never occur inside a longer UTF-8 sequence). Hashes are 64-bit polynomials
with a random value per byte, taken from one running sum and passed through a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; a running sum needs three 8-byte arrays of this length.
SEGMENT = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]

#: Odd, and 3 modulo 8, so that differences of its powers hold few factors of two.
BASE = 0xD1342543DE82EF93 | 0x3


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown when longer ones are asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = Powers(BASE)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the bounds of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the bounds of each text in their list."""
    black = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    first = black & edge[:-1]
    first[1:] |= black[1:] & ~black[:-1]
    last = black & edge[1:]
    last[:-1] |= black[:-1] & ~black[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _long_hash(data: np.ndarray, table: np.ndarray) -> np.uint64:
    """What ``hashes`` gives for one word of any length, segment by segment."""
    up, _ = _POWERS.get(SEGMENT)
    total, mask = len(data), (1 << 64) - 1
    for at in range(0, len(data), SEGMENT):
        part = table[data[at : at + SEGMENT]]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, at, 1 << 64)
    return mixed(np.array([total & mask], dtype=np.uint64))[0]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every span of bytes. ``lower`` folds A-Z."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _LOWERED if lower else _BYTES
    i = 0
    while i < len(starts):
        base = starts[i]
        if ends[i] - base > SEGMENT:
            out[i] = _long_hash(data[base : ends[i]], table)
            i += 1
            continue
        j = int(np.searchsorted(ends, base + SEGMENT, side="right"))
        up, down = _POWERS.get(int(ends[j - 1] - base))
        total = np.zeros(len(up) + 1, dtype=np.uint64)
        np.cumsum(table[data[base : ends[j - 1]]] * up, out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def hashed(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the column, and the bounds of each text in them."""
    data, bounds = raw(column)
    starts, ends, word_bounds = spans(data, bounds)
    return hashes(data, starts, ends, lower), word_bounds


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, at its first word; runs over the end of a text are hashed as well."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total *= np.uint64(BASE)
        total += words[j : j + n]
    return mixed(total + np.uint64(k))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingles of each text. A shorter text is one shingle; without words it has none."""
    all_runs = rolled(words, k)
    for i in range(len(bounds) - 1):
        start, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        if n >= k:
            yield np.unique(all_runs[start : start + n - k + 1])
        elif n:
            yield rolled(words[start : start + n], n)
        else:
            yield words[:0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows with at most ``limit`` bytes of text or one row."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop > start:
                yield batch.slice(start, stop - start)
