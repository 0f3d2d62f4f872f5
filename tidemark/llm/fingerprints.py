"""MinHash fingerprints of documents, and near-duplicates found by joining bands of them.

A fingerprint holds, for each of many universal hash functions, the smallest hash of the document's word shingles;
two fingerprints agree in a share of places that estimates the Jaccard similarity of their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm import jaccard, words
from tidemark.llm.components import components
from tidemark.llm.files import settled

PERMUTATIONS = 128
SHINGLE = 5
#: Bands of a fingerprint that are joined; at a similarity of 0.8 all of them differ once in two million times.
BANDS = 32
#: Bytes of text in a bucket of neighbouring documents, about.
BUCKET_BYTES = 1 << 25

_SLICE = 1 << 17
_LOWEST = -(1 << 63)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of ``n`` multiply-add-shift hash functions from 64 to 32 bits."""
    drawn = words.mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:n] | np.uint64(1), drawn[n:]


def signatures(column: pa.Array, k: int = SHINGLE, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of 32-bit minima per text. Texts without words have the largest value everywhere."""
    hashed, bounds = words.hashed(column, lower=True)
    runs = words.rolled(hashed, k)
    count = np.diff(bounds)
    full = np.flatnonzero(count >= k)
    out = np.full((len(count), permutations), 0xFFFFFFFF, dtype=np.uint32)
    factor, summand = _functions(permutations)

    def minima(x: np.ndarray, heads: np.ndarray, rows: np.ndarray) -> None:
        scratch = np.empty_like(x)
        for j in range(permutations):
            np.multiply(x, factor[j], out=scratch)
            scratch += summand[j]
            scratch >>= np.uint64(32)
            out[rows, j] = np.minimum(out[rows, j], np.minimum.reduceat(scratch, heads).astype(np.uint32))

    for i in np.flatnonzero((count > 0) & (count < k)):
        minima(words.rolled(hashed[bounds[i] : bounds[i + 1]], int(count[i])), np.array([0]), np.array([i]))
    # Slices of the shingles of all texts; a text may go over several.
    size = count[full] - k + 1
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0)
    index += np.repeat(bounds[full] - (ends - size), size)
    owner = np.repeat(full, size)
    for at in range(0, len(index), _SLICE):
        own = owner[at : at + _SLICE]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        minima(runs[index[at : at + _SLICE]], heads, own[heads])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=1)


def text_of(signature: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signature]


def in_neighbourhoods(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, _bucket, _lent): documents in buckets of descending doc_id, each bucket followed by the document
    that comes next to its last (``_lent``), so that every document meets its successor in one task.

    Buckets are cut at quantiles of doc_id; cuts and the first document of each bucket (one row a bucket) go to the
    driver. The text is shuffled once. Null ids come last; rows that share an id follow a hash of their text.
    """
    key, tie = F.coalesce("doc_id", F.lit(_LOWEST)).cast("long"), F.xxhash64("text")
    narrow = docs.select(key.alias("k"), tie.alias("h"), F.octet_length("text").alias("b"))
    total = narrow.agg(F.sum("b").alias("n")).first().n or 0
    n = max(1, -(-total // bucket_bytes))
    cuts = narrow.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("c")).first().c if n > 1 else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    @pandas_udf("long")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy()))

    tops = narrow.groupBy(bucket("k").alias("b")).agg(F.max(F.struct("k", "h")).alias("t")).orderBy(F.desc("b")).collect()
    # The first document of a bucket follows the last one of the bucket before; the very first follows the very last.
    lent = {(r.t.k, r.t.h): tops[i - 1].b for i, r in enumerate(tops)}

    @pandas_udf("array<long>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, k.to_numpy()).tolist()
        return pd.Series([[b, to] if (to := lent.get((x, y))) is not None else [b] for b, x, y in zip(own, k.tolist(), h.tolist(), strict=True)])

    rows = docs.select(F.col("doc_id").cast("long"), "text", key.alias("_k"), tie.alias("_h"))
    rows = rows.withColumn("_places", places("_k", "_h"))
    rows = rows.select("doc_id", "text", "_k", "_h", F.posexplode("_places").alias("_lent", "_bucket"))
    order = ["_bucket", "_lent", F.desc("_k"), F.desc("_h")]
    return rows.repartition("_bucket").sortWithinPartitions(*order).select("doc_id", "text", "_bucket", "_lent")


def compared(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """Per document (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third of code points replaced by the first as many (or all) of the next document in
    descending doc_id; the last is followed by the first. Null texts are empty, and likeness of two texts without
    words is 1. In a table of one row the next document is the row itself. Each row of a repeated id counts.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, which waits for its successor
        spare: list[tuple] = []  # rows of a bucket whose successor came

        def result(pairs: list[tuple]) -> pa.RecordBatch:
            ids = [p[0] for p in pairs]
            texts, nexts = [p[1] for p in pairs], [p[2] for p in pairs]
            edited = []
            for text, following in zip(texts, nexts, strict=True):
                n = len(text) // 3
                edited.append(text[: len(text) - n] + following[:n])
            mark, changed, after = (signatures(pa.array(x, pa.large_string()), permutations=permutations) for x in (texts, edited, nexts))
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(text_of(mark))]
            columns += [pa.array(text_of(changed)), pa.array(likeness(mark, changed)), pa.array(likeness(mark, after))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in words.pieces(batches, "text", 1 << 21):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "_bucket", "_lent"))
            for doc, text, bucket, lent in zip(*columns, strict=True):
                text = text or ""
                if held is not None and held[2] == bucket:
                    spare.append((held[0], held[1], text))
                # Rows that equal the one lent follow it; one is enough.
                held = None if lent else (doc, text, bucket)
            if spare:
                yield result(spare)
                spare = []

    near = "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_neighbourhoods(docs).mapInArrow(compare, f"doc_id long, n_chars long, {near}")


def _band_links(sets: DataFrame, hits: DataFrame, rule: jaccard.Rule, group: int) -> DataFrame:
    """Links (a, b) that join every two alike sets of a band; ``hits``: (_id, _key, _split, _g).

    A chunk of a split band is opened for a set of another chunk unless all its members are in the set's component.
    """
    found = settled(jaccard._inside(sets, hits, rule), "links")
    found = jaccard._regrouped(sets, hits, found, rule, group)
    known = components(found).select(F.col("id").alias("_id"), "component")
    state = hits.where("_split").join(known, "_id", "left").withColumn("_c", F.coalesce("component", "_id"))
    state = settled(state.select("_id", "_key", "_g", "_c"), "chunks")
    chunks = state.groupBy("_key", F.col("_g").alias("_to")).agg(F.min("_c").alias("_cl"), F.max("_c").alias("_ch"))
    new = (F.col("_g") > F.col("_to")) & ~((F.col("_cl") == F.col("_c")) & (F.col("_ch") == F.col("_c")))
    pairs = settled(state.join(chunks, "_key").where(new).select("_id", "_to", "_c"), "pairs")
    if pairs.isEmpty():
        return found
    return settled(found.union(jaccard._opened(sets.drop("_in"), state, pairs, rule, group)), "links")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 80, group: int = jaccard.GROUP) -> DataFrame:
    """(doc_id, component_id) of every row: texts whose fingerprints agree in a band and whose shingles are alike.

    Bands are joined by grouping, those of more than ``group`` sets in chunks that are then compared with each other; a
    link needs 100 * intersection >= percent * union of the whole shingle sets. Equal sets are one. Texts without words, and rows with a null id, are linked with nothing (component of a null id: null).
    """
    rule, size = jaccard.Rule(percent), PERMUTATIONS // BANDS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, "text", 1 << 21):
            hashed, bounds = words.hashed(batch.column("text"), lower=True)
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in words.shingle_sets(hashed, bounds, k)]
            bands = signatures(batch.column("text"), k).reshape(-1, BANDS, size).astype(np.uint64)
            key = np.zeros(bands.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(size):
                key = words.mixed(key + bands[:, :, j])
            keys = pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sig, pa.binary()), keys], ["_id", "_sig", "_bands"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    marked = settled(rows.mapInArrow(mark, "_id long, _sig binary, _bands array<long>"), "bands")
    unique = marked.where("_sig is not null and _id is not null").groupBy("_sig")
    unique = settled(unique.agg(F.min("_id").alias("_id"), F.first("_bands").alias("_bands")), "unique")
    hits = unique.select("_id", "_sig", F.explode("_bands").alias("_key"))
    shared = hits.groupBy("_key").agg(F.min("_id").alias("_l"), F.max("_id").alias("_h")).where("_l <> _h").select("_key")
    hits = jaccard._chunked(hits.join(shared, "_key", "left_semi"), group)
    hits = settled(hits.select("_id", "_sig", "_key", "_split", "_g"), "hits")
    sets = settled(jaccard._with_sets(rows, hits.select("_id", "_sig", F.lit(0).cast("long").alias("_in")).distinct(), k), "sets")
    linked = components(_band_links(sets, hits, rule, group))
    of = unique.select("_sig", F.col("_id").alias("id")).join(linked, "id", "left")
    of = of.select("_sig", F.coalesce("component", "id").alias("component"))
    out = marked.select("_id", F.when(F.col("_id").isNotNull(), F.col("_sig")).alias("_sig")).join(of, "_sig", "left")
    return out.select(F.col("_id").alias("doc_id"), F.coalesce("component", "_id").alias("component_id"))
