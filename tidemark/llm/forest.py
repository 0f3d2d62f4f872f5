"""Near-duplicate vectors by a forest of random-projection trees.

A tree's node splits unit vectors by a random direction, near the median of what a bounded sample has there; vectors
close to the border go to both sides (spill). Vectors are compared by their exact cosine within leaves, in tasks that
hold a few neighbouring leaves, and pairs found in any tree are links. Of several leaves that two vectors share only the
first counts their link, so that links are counted without a list of all pairs; for the components each leaf hands on
one edge a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.files import drop, settled
from tidemark.llm.words import mixed

#: Vectors linked have this cosine, or a larger one.
COSINE = 0.93
#: Trees, vectors of a leaf (about), leaves of a tree that one vector may lie in, levels below a task's node.
TREES, LEAF, PLACES, BELOW = 4, 256, 4, 5
#: Half the width of the stretch around a border in which vectors go both ways, times the root of their length.
SPILL = 0.32
#: Vectors (at most) that the splits are fitted on, random directions, and vectors of the sample that a node splits.
SAMPLE, DIRECTIONS, FITTED = 8_192, 128, 32
#: Vectors of a task's node compared in one piece (beyond, in pairs of pieces), and vectors of a task.
CHUNK, TASK_ROWS = 8_192, 8_192
SEED = 20_250_117

#: Rows of the matrix of cosines made at once, and pairs looked at.
_BLOCK, _PAIRS = 512, 1 << 18


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


class Forest:
    """Splits of all trees, fitted on a sample of unit vectors. Its size is that of the sample's tree, whatever is
    indexed: below the nodes fitted, directions follow from the node's number and borders are the sample's medians."""

    def __init__(self, sample: np.ndarray, size: int, trees: int = TREES, spill: float = SPILL, places: int = PLACES, seed: int = SEED):
        drawn = np.random.default_rng(seed)
        directions = drawn.standard_normal((size, DIRECTIONS))
        self.directions = directions / np.linalg.norm(directions, axis=0)
        self.trees, self.places, self.spill = trees, places, spill / np.sqrt(max(1, size))
        seen = sample @ self.directions if len(sample) else np.zeros((1, DIRECTIONS))
        self.medians = np.median(seen, axis=0)
        levels = max(1, int(np.log2(max(2, len(sample) / FITTED))) + 2)
        self.borders = np.full((trees, 1 << levels), np.nan)
        for tree in range(trees):
            members = {1: np.arange(len(sample))}
            for level in range(levels):
                below = {}
                for node, own in members.items():
                    if len(own) < FITTED:
                        continue
                    along = seen[own, self._direction(tree, np.array([node]))[0]]
                    self.borders[tree, node] = border = np.quantile(along, drawn.uniform(0.4, 0.6))
                    below |= {2 * node: own[along <= border], 2 * node + 1: own[along > border]}
                members = below

    def _direction(self, tree: int, node: np.ndarray) -> np.ndarray:
        return (mixed(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree + 1)) % np.uint64(DIRECTIONS)).astype(np.int64)

    def _least(self, row: np.ndarray, node: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each row the nodes that are the least far over a border."""
        by = np.lexsort((node, cost, row))
        row, node, cost = row[by], node[by], cost[by]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        turn = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)]))
        keep = turn < self.places
        return row[keep], node[keep], cost[keep]

    def leaves(self, along: np.ndarray, depth: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and node (1 at the top, 2n and 2n + 1 below n) of the leaves, ``depth`` levels down, of each row.
        ``along`` has the rows' projections."""
        row, node, cost = np.arange(len(along)), np.ones(len(along), dtype=np.int64), np.zeros(len(along))
        for level in range(int(depth.max(initial=0))):
            deeper = depth[row] > level
            r, n, c = row[deeper], node[deeper], cost[deeper]
            direction = self._direction(tree, n)
            border = self.medians[direction]
            known = n < self.borders.shape[1]
            own = self.borders[tree, np.where(known, n, 0)]
            border = np.where(known & ~np.isnan(own), own, border)
            over = along[r, direction] - border
            right = over > 0
            both = np.abs(over) <= self.spill
            row = np.concatenate([row[~deeper], r, r[both]])
            node = np.concatenate([node[~deeper], 2 * n + right, (2 * n + ~right)[both]])
            cost = np.concatenate([cost[~deeper], c, c[both] + np.abs(over[both])])
            row, node, cost = self._least(row, node, cost)
        return row, node


def usable(vectors: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """(_id, _group, _size, _v, _key) of every row. _v (its numbers as bytes, in the column's own precision) and _key (a
    digest of it) are null where the row links with nothing: no group, or a vector that is null, empty, zero, or holds
    null or non-finite components."""
    kind = vectors.schema[value].dataType.simpleString()
    dtype = "<f4" if kind == "array<float>" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(group).cast("string").alias("_group"), F.col(value).cast("array<float>" if dtype == "<f4" else "array<double>").alias("_v"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_v")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(dtype)
            bounds = np.r_[0, np.cumsum(sizes)]
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            some = np.r_[0, np.cumsum(flat != 0)]
            good = (np.diff(bad[bounds]) == 0) & (np.diff(some[bounds]) > 0) & batch.column("_group").is_valid().to_numpy(zero_copy_only=False)
            raw = [flat[a:b].tobytes() if g else None for a, b, g in zip(bounds[:-1], bounds[1:], good, strict=True)]
            columns = [batch.column("_id"), batch.column("_group"), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_group", "_size", "_v"])

    found = rows.mapInArrow(clean, "_id long, _group string, _size int, _v binary")
    return found.withColumn("_key", F.unhex(F.md5("_v")))


def _codes(forest: Forest, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, tree and node of all leaves of the vectors, by row and tree. A group of one leaf needs one tree."""
    along = unit(x) @ forest.directions
    found = []
    for tree in range(forest.trees):
        row, node = forest.leaves(along, depth, tree)
        keep = (depth[row] > 0) | (tree == 0)
        found.append(np.stack([row[keep], np.full(int(keep.sum()), tree), node[keep]]))
    row, tree, node = np.concatenate(found, axis=1)
    by = np.lexsort((node, tree, row))
    return row[by], tree[by], node[by]


_ENTRY = "_c long, _group string, _size int, _tree int, _node long, _leaves array<long>, _all array<long>, _n long, _v binary"


def _placed(forest: Forest, size: int, kind: str, vectors: bool):
    """One row for each tree and task's node that a vector lies in, with its leaves there and all of its leaves."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth = batch.column("_depth").to_numpy().astype(np.int64)
            fits = batch.column("_size").to_numpy() == size
            depth = np.where(fits, depth, 0)  # vectors of other lengths lie in one leaf
            split = np.flatnonzero(depth > 0)
            row, tree, node = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), np.ones(batch.num_rows, dtype=np.int64)
            if len(split):
                rest = np.flatnonzero(depth == 0)
                found = _codes(forest, _matrix(batch.column("_v").take(pa.array(split)), kind), depth[split])
                row = np.concatenate([split[found[0]], rest])
                tree, node = np.concatenate([found[1], tree[rest]]), np.concatenate([found[2], node[rest]])
                by = np.lexsort((node, tree, row))
                row, tree, node = row[by], tree[by], node[by]
            upper = node >> np.minimum(depth[row], BELOW)
            code = (tree << 48) | node  # trees and nodes of one depth in ascending order
            heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (tree[1:] != tree[:-1]) | (upper[1:] != upper[:-1])])
            bounds, of = np.r_[heads, len(row)], row[heads]
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            take = pa.array(of)
            own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code, pa.int64()))
            every = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(code, pa.int64())).take(take)
            columns = [batch.column("_c").take(take), batch.column("_group").take(take), batch.column("_size").take(take), pa.array(tree[heads], pa.int32()), pa.array(upper[heads])]
            names = ["_c", "_group", "_size", "_tree", "_node"]
            if vectors:
                columns += [own, every, batch.column("_n").take(take), batch.column("_v").take(take)]
                names += ["_leaves", "_all", "_n", "_v"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return place


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that two rows of ascending numbers (filled up by -1) share; -1 if none."""
    same = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=2)
    first = same.argmax(axis=1)
    at = np.arange(len(a))
    return np.where(same[at, first], a[at, first], -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def links(x: np.ndarray, codes: list[np.ndarray], every: list[np.ndarray], times: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector of a task's node: how many others (counted ``times``) it links with here, and the first one
    of its component. ``codes`` are its leaves here, ``every`` all of its leaves; only pairs of different ``side`` are
    compared if there are two."""
    n = len(x)
    width = max(map(len, every))
    table = np.full((n, width), -1, dtype=np.int64)
    for i, own in enumerate(every):
        table[i, : len(own)] = own
    owner = np.repeat(np.arange(n), [len(c) for c in codes])
    leaf = np.concatenate(codes)
    by = np.lexsort((owner, leaf))
    leaf, owner = leaf[by], owner[by]
    count, found = np.zeros(n, dtype=np.int64), []
    two = side.min() != side.max()
    for members in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
        code, own = leaf[members[0]], owner[members]
        y = x[own]
        for low in range(0, len(own), _BLOCK):
            near = y[low : low + _BLOCK] @ y[low:].T >= cosine
            for a, b in _pairs(near):
                a, b = own[a + low], own[b + low]
                keep = a < b
                if two:
                    keep &= side[a] != side[b]
                a, b = a[keep], b[keep]
                keep = _first_common(table[a], table[b]) == code
                a, b = a[keep], b[keep]
                count += np.bincount(a, times[b], n).astype(np.int64) + np.bincount(b, times[a], n).astype(np.int64)
                if len(a):
                    root = _roots(n, a, b)
                    moved = np.flatnonzero(root != np.arange(n))
                    found.append(np.stack([moved, root[moved]]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return count, _roots(n, a, b)


def _pairs(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, b = np.nonzero(near)
    for at in range(0, len(a), _PAIRS):
        yield a[at : at + _PAIRS], b[at : at + _PAIRS]


def _compared(kind: str, cosine: float):
    """(_c, _root, _links) of the vectors of a bin that link with any other in one of its nodes."""
    key = ["_group", "_size", "_tree", "_node", "_i", "_j"]

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(k, "ascending") for k in [*key, "_c"]])
        keys = list(zip(*(rows.column(k).to_pylist() for k in key), strict=True))
        out: list[list[np.ndarray]] = [[], [], []]
        start = 0
        for stop in range(1, len(keys) + 1):
            if stop < len(keys) and keys[stop] == keys[start]:
                continue
            if stop - start > 1:
                part = rows.slice(start, stop - start)
                ids, times, side = (part.column(c).to_numpy() for c in ("_c", "_n", "_side"))
                codes, every = ([np.array(v, dtype=np.int64) for v in part.column(c).to_pylist()] for c in ("_leaves", "_all"))
                count, root = links(unit(_matrix(part.column("_v"), kind)), codes, every, times, side, cosine)
                linked = np.flatnonzero(count)
                for column, values in zip(out, (ids[linked], ids[root[linked]], count[linked]), strict=True):
                    column.append(values)
            start = stop
        columns = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["_c", "_root", "_links"])

    return compare


def fitted(classes: DataFrame, size: int, kind: str, sample: int = SAMPLE, **settings) -> Forest:
    """A forest whose splits come from at most ``sample`` vectors of ``size`` numbers, drawn by a hash."""
    drawn = classes.where(F.col("_size") == size).orderBy(F.xxhash64("_key"), "_c").limit(sample).select("_v").collect()
    x = np.frombuffer(b"".join(bytes(r._v) for r in drawn), dtype=kind).reshape(len(drawn), size).astype(np.float64)
    return Forest(unit(x) if len(x) else x, size, **settings)


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", value: str = "embedding", group: str = "label", cosine: float = COSINE, leaf: int = LEAF, chunk: int = CHUNK, **settings
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``.

    Rows of one ``group`` (not null) whose vectors have a cosine of ``cosine`` or more, in double precision, and share a
    leaf of any tree, are linked. ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the
    smallest key reachable by links, and ``kept`` says whether that is the row's own. Rows without a usable vector link
    with nothing and are kept, as are rows with a null key of their own component (which is null). Equal vectors of a
    group are one class and are not compared with each other; rows that share a key are rows like others. Every usable
    vector is in every tree. Vectors of another length than most lie in one leaf a group, where all are compared. Leaves
    of a task's node that hold more than ``chunk`` vectors together are compared piece by piece, every pair once.
    """
    kind = "<f4" if vectors.schema[value].dataType.simpleString() == "array<float>" else "<f8"
    rows = settled(usable(vectors, key, value, group), "vectors")
    whole = ["_group", "_size", "_key"]
    classes = rows.where("_key is not null").groupBy(*whole).agg(F.any_value("_v").alias("_v"), F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_min"))
    classes = settled(classes.withColumn("_c", F.monotonically_increasing_id()), "classes")
    counts = settled(classes.groupBy("_group", "_size").agg(F.count(F.lit(1)).alias("_rows")), "counts")
    common = counts.groupBy("_size").agg(F.sum("_rows").alias("n")).orderBy(F.desc("n"), "_size").first()
    size = common._size if common else 1
    forest = fitted(classes, size, kind, **settings)
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / leaf))).cast("int")
    deep = classes.join(counts.select("_group", "_size", depth.alias("_depth")), ["_group", "_size"])
    entry = ["_group", "_size", "_tree", "_node"]
    narrow = "_c long, _group string, _size int, _tree int, _node long"
    many = deep.select("_c", "_group", "_size", "_depth", "_v").mapInArrow(_placed(forest, size, kind, False), narrow)
    many = settled(many.groupBy(*entry).agg(F.count(F.lit(1)).alias("_m")), "nodes")
    total = many.agg(F.sum("_m").alias("n")).first().n or 0
    pieces = F.ceil(F.col("_m") / chunk)
    large = many.where(pieces > 1).select(*entry, pieces.alias("_k"))
    entries = deep.select("_c", "_group", "_size", "_depth", "_n", "_v").mapInArrow(_placed(forest, size, kind, True), _ENTRY)
    entries = entries.join(large, entry, "left").withColumn("_k", F.coalesce("_k", F.lit(1).cast("long")))
    side = F.pmod(F.xxhash64("_c"), F.col("_k"))
    entries = entries.withColumn("_side", side)
    entries = entries.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    entries = entries.withColumns({"_i": F.least("_side", "_other"), "_j": F.greatest("_side", "_other")}).drop("_other", "_k")
    bins = max(1, -(-total // TASK_ROWS))
    binned = entries.withColumn("_bin", F.pmod(F.xxhash64(*entry, "_i", "_j"), F.lit(bins)))
    found = settled(binned.groupBy("_bin").applyInArrow(_compared(kind, cosine), "_c long, _root long, _links long"), "links")
    joined = components(found.select(F.col("_c").alias("a"), F.col("_root").alias("b")))
    degree = found.groupBy("_c").agg(F.sum("_links").alias("_links"))
    known = classes.drop("_v").join(degree, "_c", "left").join(joined.withColumnRenamed("id", "_c"), "_c", "left")
    known = settled(known.withColumn("component", F.coalesce("component", "_c")), "components")
    least = known.groupBy("component").agg(F.min("_min").alias("_least"))
    known = known.join(least, "component").select(*whole, (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.col("_least"))
    known = settled(known.withColumn("_known", F.lit(True)), "known")
    drop(classes, counts, many, found)
    out = rows.drop("_v").join(known, whole, "left")
    component = F.when(F.col("_known"), F.col("_least")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(key),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
