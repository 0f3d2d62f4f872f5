"""Merkle manifest of a dataset: trees of SHA-256 digests whose nodes carry the interval of leaf ranks they cover.

Every row is a leaf, every group of rows (a source) a tree of its own, and the trees' roots are the leaves of one last
tree. A node of level ``l`` covers the ranks from ``lo`` to under ``hi``, a range of at most 3^l that begins at a multiple
of 3^l. So no node needs a pointer to its parent: an ancestor's interval contains that of the node, and the rank divided
by the level's width names the bucket in which it is found. Siblings are what a parent's interval holds besides the
node's own interval.

Trees grow and proofs are gathered in strides of ``STRIDE`` levels. A stride's subtrees are small, lie in one bucket
each, and many of them make up one task, however large a tree is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.files import drop, settled

#: Children of a node, levels gathered in one bucket, rows of a task, about.
FAN, STRIDE, TASK_ROWS = 3, 4, 4_096

#: Name of the tree over all trees; those of groups begin with 0 (the null group) or 1.
TOP = ""

_NODES = "_tree string, _level int, _lo long, _hi long, _leaves long, _digest binary"


def h(parts: Sequence[bytes]) -> bytes:
    """SHA-256 of the parts one after the other, digests as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row (binary): of each value its length in UTF-8 bytes, ``:`` and the value; ``-`` for a null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _group(column: Column) -> Column:
    """A tree's name: orders as the values do by UTF-8 bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def height(leaves: int) -> int:
    level = 0
    while FAN**level < leaves:
        level += 1
    return level


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_at``, the place within the row's ``_tree`` in ascending ``order``, and the tree's ``_leaves``.

    Rows are range partitioned and sorted; places within a partition then only need the number of the tree's rows in
    the partitions before, from a table of one row for each tree of each partition. Rows alike in ``order`` must be
    alike in all but ``_salt``, which lets many of them be dealt to several partitions.
    """
    rows = settled(rows.withColumn("_salt", F.monotonically_increasing_id()), "rows")
    order = ["_tree", *order, "_salt"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    ordered = settled(ordered.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ordered")
    drop(rows)
    before = Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("_tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    begins = counts.select(
        "_tree",
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_begin"),
        F.sum("_n").over(Window.partitionBy("_tree")).alias("_leaves"),
    )
    begins = settled(begins, "begins")
    found = ordered.join(begins, ["_tree", "_part"])
    found = settled(found.withColumn("_at", F.col("_place") + F.col("_begin")).drop("_part", "_place", "_begin"), "ranked")
    drop(ordered, begins)
    return found


def _bins(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def _bin(tree: str, bucket: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(tree, bucket), F.lit(bins)).alias("_bin")


def _runs(tree: list, bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal (tree, bucket) in sorted rows."""
    start = 0
    for i in range(1, len(tree) + 1):
        if i == len(tree) or tree[i] != tree[start] or bucket[i] != bucket[start]:
            yield start, i
            start = i


def _grow(base: int, stride: int):
    """Nodes of levels ``base`` + 1 to ``base`` + ``stride`` above the items of a bin, level ``base`` itself at 0."""
    width = FAN**base

    def grow(items: pa.Table) -> pa.Table:
        items = items.sort_by([("_tree", "ascending"), ("_at", "ascending")])
        tree, digests = items.column("_tree").to_pylist(), items.column("_digest").to_pylist()
        at, count, leaves = (items.column(c).to_numpy() for c in ("_at", "_count", "_leaves"))
        rows: list[tuple] = []
        for start, stop in _runs(tree, at // FAN**stride):
            nodes, first, level, n = digests[start:stop], int(at[start]), base, int(count[start])
            own = (tree[start], int(leaves[start]))
            while True:
                if level > base or base == 0:
                    step = FAN ** (level - base) * width
                    rows += [(own[0], level, (first + i) * step, min((first + i + 1) * step, own[1]), own[1], d) for i, d in enumerate(nodes)]
                if n == 1 or level == base + stride:
                    break
                nodes = [h(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
                first, n, level = first // FAN, -(-n // FAN), level + 1
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        names = ["_tree", "_level", "_lo", "_hi", "_leaves", "_digest"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return grow


def grown(leaves: DataFrame, stride: int = STRIDE) -> DataFrame:
    """All nodes (_tree, _level, _lo, _hi, _leaves, _digest) above ``leaves`` (_tree, _at, _leaves, _digest), those at
    level 0. A tree of one leaf has that node only."""
    items = leaves.select("_tree", "_at", F.col("_leaves").alias("_count"), "_leaves", "_digest")
    nodes, base = None, 0
    while True:
        row = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_count"), F.lit(0)).alias("most")).first()
        bucket = F.floor(F.col("_at") / FAN**stride)
        made = items.withColumn("_bin", _bin("_tree", bucket, _bins(row.n)))
        made = settled(made.groupBy("_bin").applyInArrow(_grow(base, stride), _NODES), "nodes")
        nodes = made if nodes is None else nodes.union(made)
        if row.most <= FAN**stride:
            return nodes
        base += stride
        whole = (F.col("_level") == base) & (F.col("_hi") - F.col("_lo") < F.col("_leaves"))
        count = F.ceil(F.col("_leaves") / FAN**base)
        items = made.where(whole).select("_tree", F.floor(F.col("_lo") / FAN**base).alias("_at"), count.alias("_count"), "_leaves", "_digest")


def siblings(lo: int, hi: int, level: int, nodes: dict) -> tuple[list[bytes], list[bytes]]:
    """Of the node that covers ``lo`` to ``hi`` at ``level``, the digests before and after it: what its parent's interval
    holds besides its own. ``nodes`` has (level, lo): (hi, digest, ...)."""
    step = FAN**level
    start = lo // (FAN * step) * (FAN * step)
    left, right = [], []
    for at in range(start, start + FAN * step, step):
        other = nodes.get((level, at))
        if other is not None and (at, other[0]) != (lo, hi):
            (left if other[0] <= lo else right).append(other[1])
    return left, right


def _gather(base: int, stride: int):
    """Proof steps of the wanted items of a bin: siblings of the item and its ancestors within the stride, and then the
    path that the bucket's own top has beyond."""

    def gather(wanted: pa.Table, known: pa.Table) -> pa.Table:
        nodes: dict[tuple, dict] = {}
        above: dict[tuple, tuple[bytes, bytes]] = {}
        shared: dict[tuple, bytes] = {}
        columns = (known.column(c).to_pylist() for c in ("_tree", "_level", "_lo", "_hi", "_leaves", "_digest", "_subroot"))
        for tree, level, lo, hi, leaves, digest, subroot in zip(*columns, strict=True):
            key = (tree, lo // FAN ** (base + stride))
            if level < 0:
                above[key] = (digest, subroot)
            else:
                nodes.setdefault(key, {})[level, lo] = (hi, digest, lo == 0 and hi == leaves)

        def path(key: tuple, level: int, lo: int) -> bytes:
            """Steps from a node on; those of a parent serve its other children too."""
            if level == base + stride:
                return above[key][0]
            hi, _, whole = nodes[key][level, lo]
            if whole:
                return above[key][0]
            steps = shared.get((key, level, lo))
            if steps is None:
                left, right = siblings(lo, hi, level, nodes[key])
                width = FAN ** (level + 1)
                rest = path(key, level + 1, lo // width * width)
                steps = shared[key, level, lo] = b"".join([bytes([len(left), len(right)]), *left, *right, rest])
            return steps

        keys = [(t, i // FAN**stride) for t, i in zip(*(wanted.column(c).to_pylist() for c in ("_tree", "_at")), strict=True)]
        paths = [path(k, base, i * FAN**base) for k, i in zip(keys, wanted.column("_at").to_pylist(), strict=True)]
        out = wanted.drop_columns(["_bin"]).append_column("_path", pa.array(paths, pa.binary()))
        return out.append_column("_subroot", pa.array([above[k][1] for k in keys], pa.binary()))

    return gather


def fold(path: bytes, digest: bytes) -> tuple[bytes, list[bytes]]:
    """The root that a path leads to from ``digest``, and its siblings in order."""
    at, found = 0, []
    while at < len(path):
        left, right = path[at], path[at + 1]
        at += 2
        steps = [path[at + 32 * i : at + 32 * (i + 1)] for i in range(left + right)]
        at += 32 * (left + right)
        digest = h([*steps[:left], digest, *steps[left:]])
        found += steps
    return digest, found


def _attached(wanted: DataFrame, nodes: DataFrame, above: DataFrame, base: int, stride: int) -> DataFrame:
    """Level-bucketed containment join: ``wanted`` (_tree, _at at level ``base``, ...) with _path and _subroot.

    ``above`` has the path of the top of each bucket. Both sides lie in bins of buckets; a bucket has at most 3^stride
    items and 3/2 times as many nodes.
    """
    width = FAN ** (base + stride)
    level, none = F.col("_level"), F.lit(None).cast("binary").alias("_subroot")
    within = nodes.where((level >= base) & (level < base + stride))
    within = within.select("_tree", "_level", "_lo", "_hi", "_leaves", "_digest", none)
    zero = F.lit(0).cast("long")
    tops = above.select("_tree", F.lit(-1), F.col("_at") * width, zero, zero, "_path", "_subroot").toDF(*within.columns)
    known, bins = within.union(tops), _bins(wanted.count())
    left = wanted.toDF(*wanted.columns)  # columns of its own, as both sides may come from the same nodes
    left = left.select(_bin("_tree", F.floor(F.col("_at") / FAN**stride), bins), *wanted.columns)
    right = known.select(_bin("_tree", F.floor(F.col("_lo") / width), bins).alias("_to"), *known.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    gather = _gather(base, stride)

    def both(items: pa.Table, around: pa.Table) -> pa.Table:  # two parameters: Spark counts them
        return gather(items, around)

    wanted_bins = left.groupBy("_bin").cogroup(right.groupBy("_to"))
    return wanted_bins.applyInArrow(both, f"{schema}, _path binary, _subroot binary")


def paths(nodes: DataFrame, tops: DataFrame, wanted: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The leaves ``wanted`` (_tree, _at and more columns; every leaf must be there once) with _path and _subroot.

    ``tops`` has each tree's own path (_tree, _path, _subroot): what follows beyond its root. Strides go from the top
    down, each over a third to the power of ``stride`` of the rows of the next.
    """
    most = nodes.agg(F.max("_leaves").alias("n")).first().n or 1
    above, first = None, nodes.where("_level = 0 and _lo = 0")
    for s in range(max(1, -(-height(most) // stride)) - 1, -1, -1):
        base = s * stride
        low, high = FAN**base if s else 0, FAN ** (base + stride)
        ends = first.where((F.col("_leaves") > low) & (F.col("_leaves") <= high)).select("_tree")  # trees that end here
        ends = ends.join(tops, "_tree").select("_tree", F.lit(0).cast("long").alias("_at"), "_path", "_subroot")
        above = ends if above is None else ends.unionByName(above)
        if s == 0:
            return _attached(wanted, nodes, above, base, stride)
        items = nodes.where((F.col("_level") == base) & (F.col("_hi") - F.col("_lo") < F.col("_leaves")))
        items = items.select("_tree", F.floor(F.col("_lo") / FAN**base).alias("_at"))
        above = settled(_attached(items, nodes, above, base, stride), "paths")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: (_tree, _at, _leaves, _digest) and the kept columns of every row. ``nodes``: of all trees of groups.
    ``tops``: each tree's path to the root and its subroot. ``root`` is None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: bytes | None
    stride: int = STRIDE

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """``wanted`` leaves, some of the rows of ``leaves`` (or all), with their _path and _subroot."""
        return paths(self.nodes, self.tops, self.leaves if wanted is None else wanted, self.stride)


def build(docs: DataFrame, values: Sequence[str], group: str, order: str, keep: dict[str, Column] | None = None, stride: int = STRIDE) -> Manifest:
    """Manifest of ``docs``: a leaf per row from its ``values``, a tree per ``group``, leaves in ascending ``order``.

    Null orders come first; rows that share an order follow one another by their digests, so that any layout gives the
    same trees. Rows alike in all values have equal leaves, each with its own place. ``keep`` adds columns to the
    leaves. Texts are hashed where they are read and never move; what is shuffled is a digest a row.
    """
    kept = [c.alias(n) for n, c in (keep or {}).items()]
    rows = docs.select(_group(F.col(group)).alias("_tree"), F.col(order).alias("_order"), leaf([F.col(v) for v in values]).alias("_digest"), *kept)
    leaves = ranked(rows, ["_order", "_digest", *(keep or {})])
    nodes = grown(leaves, stride)
    # Over all of a tree lies one node: a lone leaf, or that of the last level.
    whole = (F.col("_lo") == 0) & (F.col("_hi") == F.col("_leaves"))
    trees = ranked(nodes.where(whole).select(F.lit(TOP).alias("_tree"), F.col("_tree").alias("_of"), "_digest"), ["_of"])
    upper = grown(trees, stride)
    nothing = F.lit(b"")
    end = trees.sparkSession.range(1).select(F.lit(TOP).alias("_tree"), nothing.alias("_path"), nothing.alias("_subroot"))
    tops = paths(upper, end, trees.drop("_leaves"), stride)
    tops = settled(tops.select(F.col("_of").alias("_tree"), "_path", F.col("_digest").alias("_subroot")), "tops")
    root = upper.where(whole).select("_digest").first()
    return Manifest(leaves, nodes, tops, bytes(root[0]) if root else None, stride)


def checked(manifest: Manifest, present: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of every leaf, leaf, subroot, root, proof_sha256, folded_root and verified.

    The proof's siblings are folded with the digest in the ``present`` column (the row as it is now); a row is verified
    where that leads to the manifest's root. Digests are lower-case hexadecimal; an empty table gives no row.
    """
    root = manifest.root.hex() if manifest.root else ""
    inner = [f"k{i}" for i in range(len(keep))]
    kept = [F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)]
    rows = manifest.leaves.select("_tree", "_at", *kept, "_digest", F.col(present).alias("_present"))
    rows = manifest.proofs(rows).drop("_tree", "_at")
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*inner).schema]
    schema = ", ".join([*kinds, *(f"{n} string" for n in names), "verified boolean"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("_digest", "_present", "_path", "_subroot"))
            for digest, now, path, subroot in zip(*columns, strict=True):
                folded, steps = fold(path, now)
                for column, value in zip(out, (digest.hex(), subroot.hex(), root, h(steps).hex(), folded.hex()), strict=True):
                    column.append(value)
            arrays = [*(batch.column(n) for n in inner), *(pa.array(c, pa.string()) for c in out)]
            arrays.append(pa.array([f == root for f in out[4]], pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, [*inner, *names, "verified"])

    return rows.mapInArrow(verify, schema).toDF(*keep, *names, "verified")
