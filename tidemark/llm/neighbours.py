"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing with exact ranking of the candidates.

Unit vectors are projected on random Gaussian directions and cut into cells; a table's bucket is the tuple of cells.
A query visits, besides its own bucket, neighbouring ones in the order of their estimated success (the sum of squared
distances to the cell borders crossed). Buckets are dealt to blocks, large ones in chunks; candidates are ranked in
their block by their exact cosine, and the best of all blocks and tables are merged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.files import settled

#: Tables, projections per table, cell width, buckets visited per table. A vector is sent to as many blocks as there are
#: tables; few of them with many visited buckets find as much as many with few, for less to shuffle.
TABLES, PROJECTIONS, WIDTH, PROBES = 3, 5, 1.4, 200
#: Vectors of a bucket kept together, and in a block, about.
CHUNK, BLOCK = 2_048, 16_384
SEED = 20_240_601

_SPAN = 1 << 9  # cells of a projection; unit vectors use far fewer


def _matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, size).astype(np.float64)


def _kind(vectors: DataFrame, value: str) -> str:
    """Numbers keep the column's own precision until they are compared."""
    return "<f4" if vectors.schema[value].dataType.simpleString() == "array<float>" else "<f8"


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(_id, _v): vectors as bytes of their numbers. Out go null ids and vectors that are null, zero, hold null or non-finite
    components, or have another length than most."""
    kind = _kind(vectors, value)
    numbers = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(value).cast(numbers).alias("_v"))
    rows = rows.where(F.col("_id").isNotNull() & (F.size("_v") > 0))
    size = rows.agg(F.mode(F.size("_v"), True).alias("n")).first().n or 1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("_v")), size))
            if batch.num_rows:
                flat = pc.fill_null(batch.column("_v").flatten(), float("nan")).to_numpy(zero_copy_only=False)
                x = flat.astype(kind).reshape(-1, size)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                raw = pa.array([row.tobytes() for row in x[good]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_id").filter(pa.array(good)), raw], ["_id", "_v"])

    return rows.mapInArrow(clean, "_id long, _v binary")


class Hashing:
    def __init__(self, size: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
        drawn = np.random.default_rng(seed)
        self.tables, self.projections, self.width = tables, projections, width
        self.directions = drawn.standard_normal((size, tables * projections))
        self.shifts = drawn.uniform(0, width, tables * projections)
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=projections)))
        self.weights = _SPAN ** np.arange(projections, dtype=np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (row, table, projection) and the place in each, from 0 to 1."""
        scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        at = ((unit @ self.directions + self.shifts) / self.width).reshape(-1, self.tables, self.projections)
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        return (cells + _SPAN // 2) @ self.weights

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """Buckets (row, table, probe), the likeliest first."""
        cells, place = self.cells(x)
        cost = place**2 @ (self.moves == -1).T + (1 - place) ** 2 @ (self.moves == 1).T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :count]
        return self.buckets(cells[:, :, None, :] + self.moves[best])


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def _ranked(size: int, k: int, kind: str):
    """Ranks a block's candidates of each query. Sums run along each row alone: equal vectors get equal scores."""

    def unit(x: np.ndarray) -> np.ndarray:
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]

    def rank(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if members.num_rows and queries.num_rows:
            members = members.sort_by([("_cell", "ascending"), ("_id", "ascending")])
            x, ids, cell = unit(_matrix(members.column("_v"), size, kind)), members.column("_id").to_numpy(), members.column("_cell").to_numpy()
            columns = (queries.column(c).to_pylist() for c in ("_q", "_qv", "_cells"))
            for q, v, cells in zip(*columns, strict=True):
                if cells is None:
                    at = np.arange(len(ids))
                else:
                    cells = np.unique(np.array(cells, dtype=np.int64))
                    low, high = np.searchsorted(cell, cells), np.searchsorted(cell, cells, side="right")
                    n = high - low
                    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                _, first = np.unique(ids[at], return_index=True)
                at = at[first]
                at = at[ids[at] != q]
                score = (x[at] * unit(np.frombuffer(v, kind).astype(np.float64)[None, :])).sum(axis=1)
                top = _best(ids[at], score, k)
                found.append((np.full(len(top), q), ids[at[top]], score[top]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table({n: pa.array(c.astype(t.to_pandas_dtype())) for n, c, t in zip(("query_id", "vec_id", "score"), columns, kinds, strict=True)})

    return rank


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", value: str = "embedding", k: int = 5, probes: int = PROBES, **hashing) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` (a condition) holds.

    Candidates are all other rows; ``score`` is their cosine in double precision, ties go to the smaller id. Every
    usable vector is in every table, whatever its bucket's size. A query that finds fewer than ``k`` is ranked against
    all rows, in blocks, so that small tables give all there is. An id is one vector: where it repeats, the rows count
    as one neighbour with the best of their scores.
    """
    settled_ = settled(usable(vectors, key, value), "vectors")
    first = settled_.first()
    empty = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], empty)
    kind = _kind(vectors, value)
    size = len(first._v) // np.dtype(kind).itemsize
    hasher = Hashing(size, **hashing)
    wanted = vectors.where(is_query).select(F.col(key).cast("long").alias("_id")).distinct()
    queries = settled(settled_.join(wanted, "_id").select(F.col("_id").alias("_q"), F.col("_v").alias("_qv")), "queries")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, _ = hasher.cells(_matrix(batch.column("_v"), size, kind))
            buckets = hasher.buckets(cells)
            for t in range(hasher.tables):
                table = pa.array(np.full(batch.num_rows, t, np.int32))
                yield pa.RecordBatch.from_arrays([table, pa.array(buckets[:, t]), batch.column("_id"), batch.column("_v")], ["_t", "_b", "_id", "_v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                buckets = hasher.probes(_matrix(part.column("_qv"), size, kind), probes)
                n = buckets.shape[2]
                table = np.tile(np.repeat(np.arange(hasher.tables, dtype=np.int32), n), part.num_rows)
                q = part.column("_q").take(pa.array(np.repeat(np.arange(part.num_rows), hasher.tables * n)))
                yield pa.RecordBatch.from_arrays([q, pa.array(table), pa.array(buckets.ravel())], ["_q", "_t", "_b"])

    total = settled_.count()
    blocks = max(1, -(-total * hasher.tables // BLOCK))
    entries = settled_.mapInArrow(index, "_t int, _b long, _id long, _v binary")
    chunks = settled(entries.groupBy("_t", "_b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_k")), "buckets")
    cell = F.xxhash64("_t", "_b", "_c").alias("_cell")
    block = F.pmod(F.xxhash64(F.lit(1), "_t", "_b", "_c"), F.lit(blocks)).alias("_g")
    large = chunks.where("_k > 1")  # at most one for each CHUNK entries
    members = entries.join(large, ["_t", "_b"], "left").withColumn("_c", F.pmod(F.xxhash64("_id"), F.coalesce("_k", F.lit(1))))
    members = members.select(block, cell, "_id", "_v")
    visits = queries.mapInArrow(probe, "_q long, _t int, _b long").join(chunks, ["_t", "_b"])
    visits = visits.select("_q", "_t", "_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_c"))
    visits = visits.select("_q", block, cell).groupBy("_q", "_g").agg(F.collect_list("_cell").alias("_cells"))
    visits = visits.join(queries, "_q").select(F.col("_g").alias("_to"), "_q", "_qv", "_cells")
    schema = "query_id long, vec_id long, score double"
    found = members.groupBy("_g").cogroup(visits.groupBy("_to")).applyInArrow(_ranked(size, k, kind), schema)
    found = settled(_top(found, k), "found")

    few = queries.join(found.groupBy(F.col("query_id").alias("_q")).count(), "_q", "left")
    few = settled(few.where(F.coalesce("count", F.lit(0)) < min(k, total - 1)).select("_q", "_qv"), "few")
    if few.isEmpty():
        return found
    parts = max(1, -(-total // BLOCK))
    spread = settled_.select(F.pmod(F.xxhash64("_id"), F.lit(parts)).alias("_g"), F.lit(0).cast("long").alias("_cell"), "_id", "_v")
    sent = few.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_to"), "_q", "_qv", F.lit(None).cast("array<long>").alias("_cells"))
    exact = spread.groupBy("_g").cogroup(sent.groupBy("_to")).applyInArrow(_ranked(size, k, kind), schema)
    rest = found.join(few.select(F.col("_q").alias("query_id")), "query_id", "left_anti")
    return rest.unionByName(_top(exact, k))
