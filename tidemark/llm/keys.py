"""Keys of rows that no two different rows share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(columns: Sequence[Column]) -> Column:
    """128 bits (binary) of the values, each with its length; a null differs from every value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.md5(F.concat(*parts)))


def row_key(rows: DataFrame, columns: Sequence[Column], bits: int = 64) -> Column:
    """A long that rows of ``rows`` share only if they are alike in ``columns``.

    Among n different rows about n^2 / 2^(bits + 1) pairs of hashes agree (three at 10^10 rows). One narrow pass over
    hashes and digests finds them, and the digests concerned get another hash, until all differ.
    """
    own = digest(columns)
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    seeds: dict[str, int] = {}
    while True:
        key = F.xxhash64(own)
        for moved, seed in seeds.items():
            key = F.when(own == F.unhex(F.lit(moved)), F.xxhash64(F.lit(seed), own)).otherwise(key)
        key = key.bitwiseAND(mask)
        pairs = rows.select(key.alias("_k"), own.alias("_d")).groupBy("_k").agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"))
        shared = pairs.where("_a <> _b").select(F.hex("_b").alias("_b")).collect()
        if not shared:
            return key
        for row in shared:
            seeds[row._b] = seeds.get(row._b, 0) + 1
