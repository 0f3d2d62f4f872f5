"""Interpolated modified Kneser-Ney n-grams of words, counted in Spark and stored as sorted hash arrays in shared files.

n-grams of word hashes are dealt to shards by all their words but the first: a shard sees every n-gram with the same
ending, so that in one task both the n-grams and the number of different words before each ending are complete. Sums for
the contexts, and for shorter n-grams still, are added up in that task and dealt on by hash, down to single words. A
shard holds at most one row for each different n-gram; a frequent ending brings one for each different word before it.
Workers map the files into memory and look up whole batches of texts; pages they don't touch are never read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.files import drop, local_name, mapped, put, settled, shared_folder

#: Bytes of text in a shard, and bytes counted in a task before pairs are sent off.
SHARD_BYTES, FLUSH_BYTES = 16 << 20, 8 << 20

BEGIN, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)

#: Words of an n-gram in production, and passes over the texts, each of which counts a part of the shards.
ORDER, ROUNDS = 3, 4

#: Kinds of rows: n-grams for the level below, sums of contexts, values of contexts with one word after them, and counts.
_GRAMS, _CONTEXTS, _SINGLES, _TALLY = range(4)
_SENT = "shard int, level int, kind int, blob binary, tally array<long>"
#: Sums of a context: of the values after it, and its different words of value 1, of value 2, and in all.
_SUMS = ("total", "one", "two", "kinds")

#: Bits of a hash that a file holds (its shard tells the others), and of them those that an index of a large file replaces.
_STORED, _INDEXED = 48, 16
#: Rows from which a file has an index, and the value from which a column's values are listed apart.
_LARGE, _FULL = 1 << 14, 255


def _columns(hashed: np.ndarray, bounds: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of the n-gram that ends at every token (the end of each text included), and the texts' bounds."""
    targets = np.insert(hashed, bounds[1:], END)
    bounds = bounds + np.arange(len(bounds))
    place = np.arange(len(targets)) - np.repeat(bounds[:-1], np.diff(bounds))
    columns = [targets]
    for back in range(1, order):
        before = np.full(len(targets), BEGIN)
        inside = np.flatnonzero(place >= back)
        before[inside] = targets[inside - back]
        columns.insert(0, before)
    return columns, bounds


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """One number for the words of an n-gram; a single word is its own."""
    key = columns[0]
    for word in columns[1:]:
        key = key * np.uint64(words.BASE) + word
    return words.mixed(key) if len(columns) > 1 else key


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so that sorted keys go through them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _summed(order: np.ndarray, values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], heads, dtype=np.int64) if len(heads) else np.zeros(0, dtype=np.int64)


def _heads(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, dtype=np.int64)


def _low(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64((1 << _STORED) - 1)


def _packed(keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[bytes]:
    """A sorted array of hashes and columns of numbers: sizes, numbers that don't fit a byte with their rows, the hashes'
    lower 4 bytes, their upper 2 (many: how many rows have each value of them), and a byte a number."""
    order = np.argsort(_low(keys))
    keys, columns = keys[order], [c[order] for c in columns]
    high = (_low(keys) >> np.uint64(_STORED - _INDEXED)).astype(np.uint16)
    if len(keys) >= _LARGE:
        high = np.bincount(high, minlength=1 << _INDEXED)
        high = high.astype(np.min_scalar_type(int(high.max())))
    large = [np.flatnonzero(c >= _FULL) for c in columns]
    yield np.array([len(keys), len(high), high.itemsize, *map(len, large)], dtype="<i8").tobytes()
    for rows, c in zip(large, columns, strict=True):
        yield rows.astype("<i8").tobytes()
        yield c[rows].astype("<i8").tobytes()
    yield (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    yield high.tobytes()
    for c in columns:
        yield np.minimum(c, _FULL).astype(np.uint8).tobytes()


class _Packed:
    """What ``_packed`` wrote; nothing but the index is read before it is asked for."""

    def __init__(self, data: np.ndarray, columns: int):
        self.at, self.data = 0, data
        n, highs, width, *large = self._next("<i8", 3 + columns).tolist()
        self.large = [(self._next("<i8", k), self._next("<i8", k)) for k in large]
        self.low, high = self._next("<u4", n), self._next(f"<u{width}", highs)
        self.columns = [self._next("u1", n) for _ in range(columns)]
        self.high = None if n >= _LARGE else high
        self.starts = np.r_[0, np.cumsum(high, dtype=np.int64)].astype(np.int64 if n >> 31 else np.int32) if n >= _LARGE else None

    def _next(self, kind: str, n: int) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        out = self.data[self.at : self.at + size].view(kind)
        self.at += size
        return out

    def keys(self) -> np.ndarray:
        """All hashes, as far as they are stored."""
        high = self.high if self.starts is None else np.repeat(np.arange(1 << _INDEXED), np.diff(self.starts))
        return high.astype(np.uint64) << np.uint64(_STORED - _INDEXED) | self.low

    def all(self) -> list[np.ndarray]:
        out = [c.astype(np.int64) for c in self.columns]
        for c, (rows, values) in zip(out, self.large, strict=True):
            c[rows] = values
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The columns' numbers of ``keys`` (in any order), 0 where unknown."""
        out, asked = np.zeros((len(self.columns), len(keys)), dtype=np.int64), _low(keys)
        if not len(self.low):
            return out
        if self.starts is None:
            known = self.keys()
            row = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            same = np.flatnonzero(known[row] == asked)
        else:
            high, low = (asked >> np.uint64(_STORED - _INDEXED)).astype(np.int64), asked.astype(np.uint32)
            row, end = self.starts[high], self.starts[high + 1]
            last, size = end, int((end - row).max(initial=0))
            for _ in range(size.bit_length()):
                middle = (row + end) >> 1
                less = (row < end) & (self.low[np.minimum(middle, len(self.low) - 1)] < low)
                row, end = np.where(less, middle + 1, row), np.where(less, end, middle)
            same = np.flatnonzero(row < last)
            same = same[self.low[row[same]] == low[same]]
        row = row[same]
        for into, c, (rows, values) in zip(out, self.columns, self.large, strict=True):
            found = c[row].astype(np.int64)
            full = np.flatnonzero(found == _FULL)
            found[full] = values[np.searchsorted(rows, row[full])]
            into[same] = found
        return out


def _order(keys: np.ndarray) -> np.ndarray:
    """An order of ``keys`` by all but their last bits, in whose place their rows are sorted with them: several times
    faster than an argsort."""
    mask = np.uint64((1 << len(keys).bit_length()) - 1)
    ordered = keys & ~mask | np.arange(len(keys), dtype=np.uint64)
    ordered.sort()
    return (ordered & mask).astype(np.int64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and where in it each of them begins."""
    order = _order(keys)
    ordered = keys[order]
    if np.any(ordered[1:] < ordered[:-1]):  # different only in their last bits
        order = order[np.argsort(ordered, kind="stable")]
        ordered = keys[order]
    return order, _heads(ordered)


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that ``keys`` fall in, and their rows, equal keys together."""
    order, _ = _groups(keys)
    shard = _shard(keys[order], shards)
    heads = _heads(shard)
    for start, stop in zip(heads.tolist(), np.append(heads, len(order))[1:].tolist(), strict=True):
        yield int(shard[start]), order[start:stop]


def _dealt(level: int, kind: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> list[tuple]:
    """Rows of ``_SENT``, one for each shard of the ``keys``."""
    return [(s, level, kind, b"".join(_packed(keys[own], [c[own] for c in columns])), None) for s, own in _by_shard(keys, shards)]


def _written(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """n-grams by their words: the different words, and for every n-gram its words' places among them and its values."""
    known, place = np.unique(np.concatenate(columns), return_inverse=True)
    parts = np.split(place.astype(np.min_scalar_type(max(1, len(known)))), len(columns))
    parts += [v.astype(np.min_scalar_type(int(v.max(initial=0)))) for v in values]
    head = np.array([len(columns[0]), len(known), *(p.itemsize for p in parts)], dtype="<i8")
    return b"".join([head.tobytes(), known.astype("<u8").tobytes(), *(p.tobytes() for p in parts)])


def _dealt_words(level: int, columns: list[np.ndarray], values: list[np.ndarray], by: np.ndarray, shards: int) -> list[tuple]:
    """Rows of n-grams with all their words, dealt by ``by``. Equal endings lie together, which compresses them."""
    return [(s, level, _GRAMS, _written([c[own] for c in columns], [v[own] for v in values]), None) for s, own in _by_shard(by, shards)]


def _read_words(blobs: list[bytes], level: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The words of all n-grams of ``blobs``, and their values; every n-gram is copied once, to its place."""
    sizes = [int(np.frombuffer(blob, "<i8", 1)[0]) for blob in blobs]
    columns = [np.empty(sum(sizes), np.uint64 if i < level else np.int64) for i in range(level + values)]
    start = 0
    for blob, size in zip(blobs, sizes, strict=True):
        data = np.frombuffer(blob, dtype=np.uint8)
        at = 8 * (2 + level + values)
        n, known, *widths = data[:at].view("<i8").tolist()
        vocabulary = data[at : at + 8 * known].view("<u8")
        at, own = at + 8 * known, slice(start, start + size)
        for i, (into, width) in enumerate(zip(columns, widths, strict=True)):
            found = data[at : at + n * width].view(f"<u{width}")
            into[own] = vocabulary[found] if i < level else found
            at += n * width
        start += size
    return columns[:level], columns[level:]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    names = ["shard", "level", "kind", "blob", "tally"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _count(order: int, shards: int, low: int, high: int):
    """n-grams of the shards from ``low`` to under ``high``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held = 0

        def flush() -> list[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting.clear()  # before the sort, which needs as much again
            order, heads = _groups(_key(columns))
            n, first = np.diff(np.append(heads, len(order))), order[heads]
            columns = [c[first] for c in columns]
            return _table(_dealt_words(len(columns), columns, [n], _key(columns[1:]), shards)).to_batches()

        for batch in words.pieces(batches, "text", 1 << 22):
            columns, _ = _columns(*words.hashed(batch.column("text"), lower=True), order)
            shard = _shard(_key(columns[1:]), shards)
            own = np.flatnonzero((shard >= low) & (shard < high))
            waiting.append([c[own] for c in columns])
            held += 6 * len(own)
            if held >= FLUSH_BYTES:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return count


def _merge(level: int, folder: str, shards: int, top: bool):
    """Add up a shard's n-grams of ``level`` words and their values (how often they stand in the texts, or how many
    words stand before them), store them, and send on what the levels below and the contexts need. ``top``: they were
    dealt by their endings, so that these are complete too and are stored likewise."""

    def tally(shard: int, level: int, value: np.ndarray, count: np.ndarray) -> tuple:
        sums = [*(int((value == k).sum()) for k in (1, 2, 3, 4)), int((count > 0).sum()), int(count.sum()), int(value.sum())]
        return (shard, level, _TALLY, None, sums)

    def kept(shard: int, columns: list[np.ndarray], value: np.ndarray, count: np.ndarray) -> list[tuple]:
        """Store complete n-grams; rows of their contexts."""
        level, rows = len(columns), [tally(shard, len(columns), value, count)]
        if level == 1:
            put(f"{folder}/words-{shard:09d}", _packed(columns[0], [value, count]))
            return rows
        put(f"{folder}/grams{level}-{shard:09d}", _packed(_key(columns), [value]))
        keys = _key(columns[:-1])
        order, heads = _groups(keys)
        ones = np.ones(len(value), dtype=np.int64)
        sums = [_summed(order, v, heads) for v in (value, value == 1, value == 2, ones)]
        keys, single = keys[order[heads]], sums[3] == 1
        rows += _dealt(level, _SINGLES, keys[single], [sums[0][single]], shards)
        return rows + _dealt(level, _CONTEXTS, keys[~single], [s[~single] for s in sums], shards)

    def endings(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        order, heads = _groups(_key(columns[1:]))
        own = order[heads]
        return [c[own] for c in columns[1:]], _summed(order, np.ones(len(count)), heads), _summed(order, count, heads)

    def merge(table: pa.Table) -> pa.Table:
        shard, blobs = table.column("shard")[0].as_py(), [b.as_buffer() for b in table.column("blob")]
        if level == 1:
            parts = [_Packed(np.frombuffer(b, dtype=np.uint8), 2) for b in blobs]
            columns, values = [np.concatenate([p.keys() for p in parts])], [np.concatenate(v) for v in zip(*(p.all() for p in parts), strict=True)]
        else:
            columns, values = _read_words(blobs, level, 1 if top else 2)
        order, heads = _groups(_key(columns))
        own = order[heads]
        for i in range(len(columns)):  # one after another, so that no second copy of all is held
            columns[i] = columns[i][own]
        values = [_summed(order, v, heads) for v in values]
        value, count = values[0], values[-1]
        del order, heads, own, values
        rows = kept(shard, columns, value, count)
        if top:
            columns, value, count = endings(columns, count)
            rows += kept(shard, columns, value, count)
        if len(columns) > 1:
            columns, value, count = endings(columns, count)
            if len(columns) == 1:
                rows += _dealt(1, _GRAMS, columns[0], [value, count], shards)
            else:
                rows += _dealt_words(len(columns), columns, [value, count], _key(columns), shards)
        return _table(rows)

    return merge


def _store(level: int, folder: str):
    """Add up a shard's contexts of n-grams of ``level`` words and store them."""

    def store(table: pa.Table) -> pa.Table:
        shard, keys, sums = table.column("shard")[0].as_py(), [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            part = _Packed(np.frombuffer(blob, dtype=np.uint8), 1 if kind == _SINGLES else len(_SUMS))
            keys.append(part.keys())
            own = part.all()
            sums.append([own[0], own[0] == 1, own[0] == 2, np.ones(len(own[0]))] if kind == _SINGLES else own)
        keys = np.concatenate(keys)
        order, heads = _groups(keys)
        sums = [_summed(order, np.concatenate(v), heads) for v in zip(*sums, strict=True)]
        put(f"{folder}/contexts{level}-{shard:09d}", _packed(keys[order[heads]], sums))
        return _table([(shard, level, _CONTEXTS, None, None)])

    return store


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and more give up. Where the counts of counts are too few to tell: 0.5, 1 and 1.5."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(float(k), max(0.1, d)) for k, d in zip((1, 2, 3), raw, strict=True))


@dataclass
class Model:
    """Where the sorted arrays are, and a few sums over the corpus."""

    folder: str
    shards: int
    words: int
    tokens: int
    pairs: int  # different ones
    discounts: list[tuple[float, float, float]]  # of n-grams of 1, 2, ... words
    rest: float  # of the continuation distribution, given to all words and one unknown alike

    def __post_init__(self) -> None:
        self.open: dict[str, _Packed] = {}

    def _file(self, kind: str, shard: int, columns: int) -> _Packed:
        """A shard's array. A shard in which nothing was counted has no file."""
        path = f"{self.folder}/{kind}-{shard:09d}"
        if path not in self.open:
            if len(self.open) >= 256:
                self.open.clear()
            if (name := local_name(path)) and not os.path.exists(name):
                none = np.zeros(0, dtype=np.int64)
                data = np.frombuffer(b"".join(_packed(none.astype(np.uint64), [none] * columns)), dtype=np.uint8)
            else:
                data = mapped(path)
            self.open[path] = _Packed(data, columns)
        return self.open[path]

    def look_up(self, kind: str, keys: np.ndarray, order: np.ndarray, by: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the different ``keys``, 0 where unknown, and the place of each key among these. They were dealt by
        ``by``, which ``order`` brings into the order of shards."""
        ordered = keys[order]
        heads = _heads(ordered)
        ordered, shard = ordered[heads], _shard(by[order[heads]], self.shards)
        values = np.empty((columns, len(ordered)), dtype=np.int64)
        cuts = [*_heads(shard).tolist(), len(shard)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            values[:, start:stop] = self._file(kind, int(shard[start]), columns).find(ordered[start:stop])
        which = np.empty(len(keys), dtype=np.int64)
        which[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        return values, which

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Of each text: tokens, known tokens, base score and score, both log10."""
        columns, bounds = _columns(*words.hashed(column, lower=True), len(self.discounts))

        def given(value: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
            return np.maximum(value - np.choose(np.minimum(value, 3), [0, *cut]), 0)

        (before, count), which = self.look_up("words", columns[-1], _order(columns[-1]), columns[-1], 2)
        count = count[which]
        chance = (given(before, self.discounts[0]) / max(1, self.pairs) + self.rest / (self.words + 1))[which]
        for level, cut in enumerate(self.discounts[1:], 2):
            by = whole = _key(columns[-level:])
            if level < len(columns):
                ending, order = whole, _order(whole)
            else:  # dealt by their endings, the n-grams of the level below
                by = ending if level > 2 else columns[-1]
                order = order if level > 2 else _order(by)
            n, which = self.look_up(f"grams{level}", whole, order, by, 1)
            kept = given(n[0], cut)[which]
            context = _key(columns[-level:-1])
            (total, one, two, kinds), which = self.look_up(f"contexts{level}", context, _order(context), context, len(_SUMS))
            some = np.maximum(total, 1)
            left = np.where(total > 0, (cut[0] * one + cut[1] * two + cut[2] * (kinds - one - two)) / some, 1.0)
            chance = kept / some[which] + left[which] * chance
        base = (count + 1) / (self.tokens + self.words + 1)
        sums = [np.diff(bounds), count > 0, np.log10(base), np.log10(chance)]
        heads = bounds[:-1]
        summed = [np.add.reduceat(v, heads, dtype=np.float64) if len(heads) else np.zeros(0) for v in sums[1:]]
        return {"n_tokens": sums[0], "n_known": summed[0].astype(np.int64), "base_score": summed[1], "score": summed[2]}


def fit(texts: DataFrame, shard_bytes: int = SHARD_BYTES, order: int = 2, rounds: int = ROUNDS) -> Model:
    """Model of n-grams of ``order`` words (2 at least) of all of ``texts`` (text, A-Z lower-cased; null: empty).

    ``order`` - 1 marks stand before each text. All it counts stays in shared files and grows with the input; the
    driver gets sums only. An empty table gives a model of one unknown word."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards, folder = max(1, -(-total // shard_bytes)), shared_folder(spark, "kneser")
    rounds = min(rounds, shards)
    cuts = [i * shards // rounds for i in range(rounds + 1)]
    parts, tallies = [], {}
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        sent = texts.select("text").mapInArrow(_count(order, shards, low, high), _SENT)
        parts.append(settled(sent.groupBy("shard").applyInArrow(_merge(order, folder, shards, top=True), _SENT), "grams"))
    complete = [order, order - 1]
    while parts:
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.union(part)
        sums = [F.sum(F.get("tally", F.lit(i))).alias(f"t{i}") for i in range(7)]
        tallies |= {r.level: r[1:] for r in merged.where(F.col("kind") == _TALLY).groupBy("level").agg(*sums).collect()}
        for level in complete:
            own = merged.where((F.col("level") == level) & F.col("kind").isin(_CONTEXTS, _SINGLES))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True) if level > 1 else ():
                some = own.where((F.col("shard") >= low) & (F.col("shard") < high))
                drop(settled(some.groupBy("shard").applyInArrow(_store(level, folder), _SENT), "contexts"))
        below = []
        if (level := complete[-1] - 1) > 0:
            below = merged.where(F.col("kind") == _GRAMS).groupBy("shard")
            below = [settled(below.applyInArrow(_merge(level, folder, shards, top=False), _SENT), "grams")]
        drop(*parts)
        parts, complete = below, [level]
    tallies = [tallies.get(level, (0,) * 7) for level in range(1, order + 1)]
    b1, b2, _, _, known, tokens, pairs = tallies[0]
    given_up = [discounts(*t[:4]) for t in tallies]
    d1, d2, d3 = given_up[0]
    rest = (d1 * b1 + d2 * b2 + d3 * (known - b1 - b2)) / pairs if pairs else 1.0
    return Model(folder, shards, known, tokens, pairs, given_up, rest)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, n_tokens, n_known, train_tokens, base_score and score of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = [f"k{i}" for i in range(len(keep))]  # names that can't clash
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col("text").alias("_text"))
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*inner).schema]
    schema = ", ".join([*kinds, "n_tokens long, n_known long, train_tokens long, base_score double, score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, "_text", 1 << 22):
            found = sent.value.score(batch.column("_text"))
            found["train_tokens"] = np.full(batch.num_rows, sent.value.tokens, dtype=np.int64)
            columns = [batch.column(c) for c in inner] + [pa.array(found[n]) for n in names]
            yield pa.RecordBatch.from_arrays(columns, [*inner, *names])

    return rows.mapInArrow(score, schema).toDF(*keep, *names)
