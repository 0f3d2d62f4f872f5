"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.files import drop, settled


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row.n, row.h


def _star(pairs: DataFrame, keep_small: bool) -> DataFrame:
    """``pairs``: (u, v). Neighbours of each u get linked with the smallest of them and u itself.

    The smallest is a plain aggregate, so that a node with many neighbours is combined before the shuffle,
    and the join back to the pairs is one whose large partitions adaptive execution can split.
    """
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if keep_small:  # small star: v <= u
        out = joined.select(F.col("v").alias("a"), "m").union(least.select(F.col("u").alias("a"), "m"))
    else:  # large star: only larger neighbours move
        out = joined.where("v > u").select(F.col("v").alias("a"), "m")
    return out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b: long, no nulls); component is the smallest id reachable.

    Repeated edges and loops change nothing; a node that has only a loop is left out, as is an empty table's.
    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settled(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, keep_small=False)
        last, edges = edges, settled(_star(large, keep_small=True), "edges")
        drop(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
