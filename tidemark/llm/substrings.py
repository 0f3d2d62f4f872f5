"""Removal of word windows that repeat anywhere in the corpus, by Rabin-Karp hashes of every fixed-length window.

Hashes are drawn to shards by a second, independent hash and counted there; shard and hash together have more than 64
bits, and more with every shard, so that chance collisions stay rarer than one in a thousand corpora at any size.
Repeated windows go back to their documents and merge into maximal intervals, which are removed. A window that repeats
among the texts that a task hashes together is known to repeat at once: its places go to their documents, and only its
hash, once, to the shard, so that a passage of very many documents is no large group anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.files import settled

WINDOW = 35
#: Bytes of text whose windows make a shard, and bytes hashed before their windows are sent off.
SHARD_BYTES, FLUSH_BYTES = 12 << 20, 12 << 20

_SENT = "shard int, keys binary, counts binary, hashes binary, steps binary, far binary"
_FOUND = "home int, keys binary, counts binary, steps binary, far binary"
_POWERS = [words.Powers(words.BASE), words.Powers(0xA0761D6478BD642B)]


def windows(hashed: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` words, at their first word: the hash rolls on as a difference of running sums."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, words.SEGMENT):
        stop = min(n, at + words.SEGMENT)
        part = hashed[at : stop + size - 1]
        up, down = _POWERS[which].get(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up, out=total[1:])
        out[at:stop] = (total[size:] - total[:-size])[: stop - at] * down[: stop - at]
    return words.mixed(out)


def _steps(places: np.ndarray) -> tuple[bytes, bytes]:
    """Differences of places in one byte each; the long ones apart."""
    return np.minimum(places, 255).astype(np.uint8).tobytes(), places[places >= 255].astype("<u4").tobytes()


def _unstepped(steps: bytes, far: bytes) -> np.ndarray:
    out = np.frombuffer(steps, dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(far, dtype="<u4")
    return out


def _home(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the documents of ``keys`` (int64) are put together again."""
    return (words.mixed(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _ranges(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different value and its places, in their order."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(values[own[0]]), own


def _by_document(keys: np.ndarray, places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the documents that have places, how many each has, and differences of places within documents."""
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    steps = np.diff(places, prepend=0)
    steps[heads] = places[heads]
    return keys[owner[heads]], np.diff(np.append(heads, len(owner))), steps


def sent_windows(keyed: DataFrame, size: int, shards: int) -> DataFrame:
    """Windows on their way, packed by document. With ``hashes``: to a shard, windows that a task saw once, and behind
    them the hashes alone of those that it saw more often. Without: the places of the latter, to their documents' home."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([w[0] for w in waiting])
            hashed = np.concatenate([w[1] for w in waiting])
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w[2]) for w in waiting]))])
            count = np.maximum(0, np.diff(bounds) - size + 1)
            owner = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = bounds[owner] + place
            value = windows(hashed, size)[first]
            shard = ((windows(hashed, size, 1)[first] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((value, shard))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (value[order[1:]] != value[order[:-1]]) | (shard[order[1:]] != shard[order[:-1]])
            once = fresh & np.r_[fresh[1:], True]
            single, marks = np.sort(order[once]), order[fresh & ~once]
            marked = {s: value[marks[own]] for s, own in _ranges(shard[marks])}
            rows = []
            for s, own in _ranges(shard[single]):
                own = single[own]
                doc, n, steps = _by_document(keys, place[own], owner[own])
                hashes = np.concatenate([value[own], marked.pop(s, value[:0])])
                rows.append((s, doc.tobytes(), n.astype("<u4").tobytes(), hashes.tobytes(), *_steps(steps)))
            rows += [(s, b"", b"", hashes.tobytes(), b"", b"") for s, hashes in marked.items()]
            several = np.sort(order[~once])
            for h, own in _ranges(_home(keys[owner[several]], shards)):
                own = several[own]
                doc, n, steps = _by_document(keys, place[own], owner[own])
                rows.append((h, doc.tobytes(), n.astype("<u4").tobytes(), None, *_steps(steps)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(_SENT))

        for batch in words.pieces(batches, "text", 1 << 22):
            column = batch.column("text")
            waiting.append((batch.column("_key").to_numpy(), *words.hashed(column)))
            held += words.raw(column)[0].size
            if held >= FLUSH_BYTES:
                yield flush()
                waiting, held = [], 0
        if waiting:
            yield flush()

    return keyed.select("_key", "text").mapInArrow(send, _SENT)


def repeated_windows(keyed: DataFrame, size: int, shards: int) -> DataFrame:
    """(home, keys, counts, steps, far): first words of windows that start elsewhere too, packed by document.

    ``keyed`` has ``_key`` (long, equal for rows with equal id and text) and ``text``.
    """

    def count(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("hashes")))  # places found to repeat, and on the way to their documents
        out = list(zip(*(known.column(n).to_pylist() for n in ("shard", "keys", "counts", "steps", "far")), strict=True))
        table = table.filter(pc.is_valid(table.column("hashes")))
        rows = [c.to_pylist() for c in (table.column(n) for n in _names(_SENT)[1:])]
        places = np.array([len(s) for s in rows[3]], dtype=np.int64)
        marks = np.array([len(h) // 8 for h in rows[2]], dtype=np.int64) - places
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(h, dtype=np.uint64) for h in rows[2])])
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        often = np.zeros(len(hashes), dtype=bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        del hashes, order
        at = 0
        for (keys, counts, _, steps, far), mark in zip(zip(*rows, strict=True), marks.tolist(), strict=True):
            counts, steps = np.frombuffer(counts, dtype="<u4"), _unstepped(steps, far)
            owner = np.repeat(np.arange(len(counts)), counts)
            hit = often[at : at + len(steps)]
            at += len(steps) + mark
            if not hit.any():
                continue
            total = np.cumsum(steps)
            heads = np.cumsum(counts) - counts
            place = total - np.repeat(total[heads] - steps[heads], counts)
            keys = np.frombuffer(keys, dtype=np.int64)
            place, owner = place[hit], owner[hit]
            for h, own in _ranges(_home(keys, shards)[owner]):
                doc, n, steps_ = _by_document(keys, place[own], owner[own])
                out.append((h, doc.tobytes(), n.astype("<u4").tobytes(), *_steps(steps_)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int32()] + [pa.binary()] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(_names(_FOUND), columns, kinds, strict=True)})

    return sent_windows(keyed, size, shards).groupBy("shard").applyInArrow(count, _FOUND)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def without_repeats(docs: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, intervals) of every row of ``docs`` (doc_id, text).

    A window is ``size`` consecutive words of one text. Every word goes that is in a window whose words also start
    anywhere else, in the same text too; windows are judged on the input. ``intervals`` are the maximal runs of words
    removed (first, one past the last), ``kept`` the words left, joined by a space. Null texts have no words. Rows that
    repeat an id and text repeat all its windows, and each comes out. Texts are whole, however long.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_key", F.xxhash64("doc_id", "text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(1, -(-total // shard_bytes))
    # Written, so that the shuffled windows can go before the texts are shuffled.
    found = settled(repeated_windows(rows, size, shards), "repeats")

    def key_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_home", pa.array(_home(batch.column("_key").to_numpy(), shards)))

    def cut(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        starts: dict[int, list[np.ndarray]] = {}
        for keys, counts, steps, far in zip(*(hits.column(n).to_pylist() for n in _names(_FOUND)[1:]), strict=True):
            counts = np.frombuffer(counts, dtype="<u4")
            parts = np.split(_unstepped(steps, far), np.cumsum(counts)[:-1])
            for doc, part in zip(np.frombuffer(keys, dtype=np.int64).tolist(), parts, strict=True):
                starts.setdefault(doc, []).append(np.cumsum(part))
        out: dict[str, list] = {n: [] for n in ("n_words", "n_removed", "kept", "intervals")}
        for batch in texts.to_batches(max_chunksize=500):
            data, bounds = words.raw(batch.column("text"))
            held = data.tobytes()
            first, last, at = words.spans(data, bounds)
            for i, doc in enumerate(batch.column("_key").to_pylist()):
                begin, end = first[at[i] : at[i + 1]], last[at[i] : at[i + 1]]
                cover = np.zeros(len(begin) + 1, dtype=np.int64)
                if doc in starts:
                    place = np.concatenate(starts[doc])
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + size, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                stay = ~gone
                out["n_words"].append(len(begin))
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(b" ".join(held[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)).decode())
                out["intervals"].append([{"first": a, "last": b} for a, b in edge.reshape(-1, 2).tolist()])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
        columns = {n: pa.array(c, kind) for (n, c), kind in zip(out.items(), kinds, strict=True)}
        return pa.table({"doc_id": texts.column("doc_id"), **columns})

    homes = rows.mapInArrow(key_home, "doc_id long, text string, _key long, _home int")
    schema = "doc_id long, n_words long, n_removed long, kept string, intervals array<struct<first: long, last: long>>"
    return homes.groupBy("_home").cogroup(found.groupBy("home")).applyInArrow(cut, schema)
