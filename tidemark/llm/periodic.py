"""Runs of words: maximal stretches that repeat with a short period, by a branching-tandem test on an enhanced suffix array.

The suffixes of all texts of a batch are sorted together, each text's apart from the others'. For every interval of the
suffix array whose suffixes share exactly ``d`` words, the suffixes of all children but the largest are asked whether
the suffix ``d`` words on, or ``d`` words back, lies in the interval too, in another child (its place in the suffix
array tells): there two equal blocks of ``d`` words stand side by side and the square doesn't go on. A square is the last
of its run; rotating it to the left, word by word, gives the whole run. No tree is built: intervals are pairs of places.

Everything is done with whole arrays; a long text costs its length times the logarithm of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Bytes of text whose suffixes are sorted together, and pairs of suffix and interval tested at once, about.
BATCH_BYTES, PAIRS = 1 << 21, 1 << 22


class Suffixes:
    """Suffix array ``order``, its inverse ``place`` and ``lcp`` of several texts of word hashes.

    Each text ends in a place of its own that equals no other. ``ranks[l]`` numbers the classes of suffixes that are
    alike in their first 2^l words, as far as any two are.
    """

    def __init__(self, hashed: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        texts = len(sizes)
        self.starts = bounds[:-1] + np.arange(texts)
        self.ends = bounds[1:] + np.arange(texts)
        n = len(hashed) + texts
        self.text = np.repeat(np.arange(texts, dtype=np.int64), sizes + 1)
        end = np.zeros(n, dtype=bool)
        end[self.ends] = True
        key = np.zeros(n, dtype=np.uint64)
        key[~end] = hashed
        order = np.lexsort((key, ~end, self.text))
        fresh = np.ones(n, dtype=bool)
        a, b = order[1:], order[:-1]
        fresh[1:] = (self.text[a] != self.text[b]) | (key[a] != key[b]) | end[a] | end[b]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.ranks, self.words = [rank], rank
        step = 1
        while True:
            tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))  # places of suffixes alike so far
            if not len(tied):
                break
            own = order[tied]
            head, after = rank[own], rank[own + step]
            by = np.lexsort((after, head))
            own, head, after = own[by], head[by], after[by]
            order[tied] = own
            fresh[tied[1:]] |= (head[1:] != head[:-1]) | (after[1:] != after[:-1])
            at = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
            rank = rank.copy()
            rank[own] = at
            self.ranks.append(rank)
            step *= 2
        self.order, self.place = order, rank
        self.lcp = np.zeros(n, dtype=np.int32)
        near = np.flatnonzero(self.words[order[1:]] == self.words[order[:-1]]) + 1
        self.lcp[near] = self.common(order[near - 1], order[near])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` (different places of one text) have in common."""
        found = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            same = np.flatnonzero(rank[a + found] == rank[b + found])
            found[same] += 1 << level
        return found


def _smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest place before and after it with a smaller value (-1 and the length if none), by
    descent through the minima of ranges of 2, 4, 8, ... places."""
    n = len(values)
    minima = [values]
    while 2 << (len(minima) - 1) <= n:
        last, half = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last[:-half], last[half:]))
    before, after = np.arange(n) - 1, np.arange(n) + 1
    for level in range(len(minima) - 1, -1, -1):
        size, low = 1 << level, minima[level]
        at = np.flatnonzero(before - size + 1 >= 0)
        go = at[low[before[at] - size + 1] >= values[at]]
        before[go] -= size
        at = np.flatnonzero(after + size <= n)
        go = at[low[after[at]] >= values[at]]
        after[go] += size
    return before, after


def _children(suffixes: Suffixes) -> tuple[np.ndarray, ...]:
    """Children but the largest of all intervals that may hold a run's square: first and last place, and the interval's
    first and last place and depth."""
    # A stretch of places with common words is closed in by zeros, so places of other stretches are never compared.
    inner = np.flatnonzero(suffixes.lcp > 0)
    none = (np.zeros(0, dtype=np.int64),) * 5
    if not len(inner):
        return none
    apart = np.r_[True, np.diff(inner) > 1]
    edge, spot = np.flatnonzero(apart), np.arange(len(inner)) + 2 * np.cumsum(apart) - 1
    values = np.zeros(spot[-1] + 2, dtype=np.int64)
    values[spot] = suffixes.lcp[inner]
    before, after = _smaller(values)
    at = np.zeros(len(values), dtype=np.int64)
    at[spot] = inner
    at[spot[edge] - 1] = inner[edge] - 1  # the zero before a stretch stands at the stretch's first suffix
    last = np.r_[edge[1:] - 1, len(inner) - 1]
    at[spot[last] + 1] = inner[last] + 1
    first, stop, depth = at[before[spot]], at[after[spot]], suffixes.lcp[inner].astype(np.int64)
    owner = suffixes.text[suffixes.order[inner]]
    fits = depth * TIMES <= (suffixes.ends - suffixes.starts)[owner]
    inner, first, stop, depth = inner[fits], first[fits], stop[fits], depth[fits]
    if not len(inner):
        return none
    # Borders of one interval are those with its first place and its depth.
    by = np.lexsort((inner, depth, first))
    inner, first, stop, depth = inner[by], first[by], stop[by], depth[by]
    begins = np.r_[True, (first[1:] != first[:-1]) | (depth[1:] != depth[:-1])]
    heads = np.flatnonzero(begins)
    count = np.diff(np.r_[heads, len(inner)])
    # Every border starts a child; the interval's first child starts at its first place.
    low = np.insert(inner, heads, first[heads])
    group = np.insert(np.cumsum(begins) - 1, heads, np.arange(len(heads)))
    high = np.r_[low[1:], 0]
    ends = np.cumsum(count + 1) - 1
    high[ends] = stop[heads]
    size = high - low
    largest = np.lexsort((low, -size, group))[np.r_[0, ends[:-1] + 1]]
    keep = np.ones(len(low), dtype=bool)
    keep[largest] = False
    own = heads[group[keep]]
    return low[keep], high[keep], first[own], stop[own], depth[own]


def squares(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares that don't go on, of periods that a run in the text can have."""
    low, high, first, stop, depth = _children(suffixes)
    sizes = high - low
    found = []
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS, int(sizes.sum()) + PAIRS, PAIRS))
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
        n = sizes[a:b]
        if not n.sum():
            continue
        child = np.repeat(np.arange(a, b), n)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[child]
        i, d = suffixes.order[spot], depth[child]
        for start, other in ((i, i + d), (i - d, i - d)):
            inside = np.flatnonzero(other >= 0)
            place = suffixes.place[other[inside]]
            c = child[inside]
            within = (place >= first[c]) & (place < stop[c]) & ((place < low[c]) | (place >= high[c]))
            found.append(np.stack([start[inside][within], d[inside][within]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, period


def _rotated(codes: np.ndarray, begin: int, start: int, period: int) -> int:
    """Where the run of a square starts: the square is moved left while the word that enters is the one that leaves."""
    step = 64
    while start > begin:
        low = max(begin, start - step)
        other = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(other):
            return low + int(other[-1]) + 1
        start, step = low, 2 * step
    return start


def runs(hashed: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of every run, ordered by text, start and period.

    A run is a stretch of at least ``least`` words and ``times`` smallest periods (``TIMES`` or more) that can't be
    extended with that period."""
    suffixes = Suffixes(hashed, bounds)
    start, period = squares(suffixes)
    text = suffixes.text[start]
    begin = suffixes.starts[text]
    # Long enough: the words before the square repeat as well.
    need = np.maximum(least, times * period) - 2 * period
    at = np.flatnonzero(start - need >= begin)
    start, period, text, need = start[at], period[at], text[at], need[at]
    long = suffixes.common(start - need, start - need + period) >= need + period
    start, period, text = start[long], period[long], text[long]
    by = np.lexsort((period, start + 2 * period))
    found: list[tuple[int, int, int, int]] = []
    codes, last, own = suffixes.words, -1, []
    for s, p, t in zip(start[by].tolist(), period[by].tolist(), text[by].tolist(), strict=True):
        if s + 2 * p != last:
            last, own = s + 2 * p, []
        # A multiple of the smallest period of a run that ends here gives the same run.
        if any(p % q == 0 and first <= last - 2 * p for first, q in own):
            continue
        offset = int(suffixes.starts[t])
        first = _rotated(codes, offset, s, p)
        own.append((first, p))
        found.append((t, first - offset, last - first, p))
    table = np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), dtype=np.int64).reshape(-1, 4)
    return tuple(table.T)


def kept_words(sizes: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word stays (texts one after the other): a word of any run behind its first period goes."""
    bounds = np.r_[0, np.cumsum(sizes)]
    change = np.zeros(bounds[-1] + 1, dtype=np.int64)
    np.add.at(change, bounds[text] + start + period, 1)
    np.add.at(change, bounds[text] + start + length, -1)
    return np.cumsum(change[:-1]) == 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Of each text its kept words, joined by one space. ``bounds`` are those of the texts in the list of words."""
    own = np.flatnonzero(keep)
    change = np.zeros(len(data) + 1, dtype=np.int8)
    change[starts[own]] += 1
    change[ends[own]] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    text = np.searchsorted(bounds, own, side="right") - 1
    more = own[:-1][text[1:] == text[:-1]] if len(own) else own
    data = data.copy()
    data[ends[more]] = 32  # the white space after a word that isn't the text's last
    mask[ends[more]] = True
    lengths = np.bincount(text, weights=(ends - starts)[own], minlength=len(bounds) - 1).astype(np.int64)
    lengths += np.bincount(text[:-1][text[1:] == text[:-1]], minlength=len(bounds) - 1) if len(own) else 0
    offsets = np.r_[0, np.cumsum(lengths)]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(data[mask].tobytes()))


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``keep`` columns of every row, its runs (an array, by start and period) and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts have no runs and an empty text. Rows stay where they
    are: nothing is shuffled, equal rows are all found. A text is one task's work, whatever its length, and short ones
    are done together.
    """
    inner = [f"k{i}" for i in range(len(keep))]  # names that can't clash
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col(text).alias("_text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*inner).schema]
    schema = ", ".join([*kinds, f"runs {_RUN}", "collapsed string"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, "_text", BATCH_BYTES):
            data, limits = words.raw(batch.column("_text"))
            starts, ends, bounds = words.spans(data, limits)
            found = runs(words.hashes(data, starts, ends), bounds, least, times)
            of, *columns = found
            stays = kept_words(np.diff(bounds), of, *columns)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"]),
            )
            collapsed = joined(data, starts, ends, bounds, stays).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), lists, collapsed], [*inner, "runs", "collapsed"])

    return rows.mapInArrow(search, schema).toDF(*keep, "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of the ids with its tail replaced by a stretch that repeats with a period drawn by id."""
    drawn = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g, found = F.floor(drawn / 10), F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(found)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # Whole stretches, since what stands in a lambda function is computed again for each word.
    tail = F.slice(F.flatten(F.array_repeat(F.slice(found, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    moved = F.concat_ws(" ", F.slice(found, F.lit(1), a), tail)
    return F.when((drawn % 10 == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), moved).otherwise(text)
