"""Sharded Parquet datasets: discovery, smoke subsets, pruned reads, row ids."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed


def read_shards(
    spark: SparkSession,
    path: str,
    columns: Sequence[Column | str] | None = None,
    first: int | None = None,
) -> DataFrame:
    """All Parquet shards under ``path``. Raises ``AnalysisException`` when there are none.

    ``columns`` prunes the scan. ``first`` keeps all files of the first n shards by name, for smoke
    runs: a shard is a folder of a partitioned export, or in a flat one what a task wrote, however many
    files that took. Only file names pass through the driver, which lists them anyway to plan the scan.
    """
    df = spark.read.parquet(path)
    if first is not None:
        chosen = [f for own in list(_by_shard(df).values())[:first] for f in own]
        df = spark.read.schema(df.schema).option("basePath", path).parquet(*chosen)
    return df.select(*columns) if columns else df


def _by_shard(df: DataFrame) -> dict[str, list[str]]:
    """Files of each shard, shards by name."""
    files = sorted(df.inputFiles())
    flat = len({os.path.dirname(f) for f in files}) == 1
    found: dict[str, list[str]] = {}
    for file in files:
        found.setdefault(shard_name(file, flat), []).append(file)
    return dict(sorted(found.items()))


def each_shard(spark: SparkSession, path: str) -> list[DataFrame]:
    """The shards under ``path`` one by one, by name, for what goes through them in order."""
    df = spark.read.parquet(path)
    return [spark.read.schema(df.schema).option("basePath", path).parquet(*own) for own in _by_shard(df).values()]


def shard_name(file: str, flat: bool) -> str:
    """The shard a file belongs to: its folder, or in a ``flat`` export its name without the file counter."""
    return re.sub(r"[-.]c[0-9]+(?=[.])", "", file) if flat else os.path.dirname(file)


def read_smoke(spark: SparkSession, path: str, columns: Sequence[Column | str] | None = None) -> DataFrame:
    return read_shards(spark, path, columns, first=fixed.SMOKE_SHARDS)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a unique id from the shard name and the row's place in it.

    No shuffle and no counter: the id is the same in every run over the same files, so
    hash-based sampling stays exact for rows that are copies of each other.
    Apply it to a frame straight from ``read_shards``.
    """
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return df.select("*", place.alias(name))
