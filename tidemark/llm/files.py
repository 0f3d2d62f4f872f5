"""Tables and plain files in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_dir


#: Spark then deletes an execution's shuffle files when it ends, instead of when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder: later steps start from files, whatever executors are lost.

    The write's own shuffle files go with it, so that the executors' disks hold those of one step at a time. A lost
    executor during the write is dealt with as usual; after it, nothing needs them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``settled`` wrote; nothing may read them any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names of our own (``c0``, ``c1``, ...), so that no name clashes, and those names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new shared folder's name, for files that tasks write themselves."""
    return scratch_dir(spark, purpose)


def local_name(path: str) -> str | None:
    """The path in the mounted file system, or None if it lies in another store."""
    parts = urlparse(path)
    return parts.path if parts.scheme in ("", "file") else None


def put(path: str, chunks: Iterator[bytes] | list[bytes]) -> int:
    """Write a file so that it appears whole or not at all; a repeated task replaces it by the same bytes."""
    own, size = f"{path}.{uuid.uuid4().hex}", 0
    if name := local_name(path):
        own = local_name(own)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(own, "wb") as out:
            for chunk in chunks:
                size += out.write(chunk)
        os.replace(own, name)
        return size
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_output_stream(own := fs.FileSystem.from_uri(own)[1]) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(own, name)
    return size


def mapped(path: str) -> np.ndarray:
    """The file's bytes, memory-mapped where the store is mounted; elsewhere they are read."""
    if name := local_name(path):
        return np.memmap(name, dtype=np.uint8, mode="r") if os.path.getsize(name) else np.zeros(0, dtype=np.uint8)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype=np.uint8)
