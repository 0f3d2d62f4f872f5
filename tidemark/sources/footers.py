"""Profile of Parquet datasets from their files' footers: rows, row groups and bytes without reading a data page."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOOTER = "file string, n_rows long, row_groups long, bytes long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("file").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                about = pq.read_metadata(file)
            size = sum(about.row_group(i).column(c).total_compressed_size for i in range(about.num_row_groups) for c in range(about.num_columns))
            rows.append((path, about.num_rows, about.num_row_groups, size))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "n_rows", "row_groups", "bytes"])


def footers(spark: SparkSession, path: str, files_per_task: int = 64) -> DataFrame:
    """(file, n_rows, row_groups, bytes) of every Parquet file under ``path``; bytes are those of the column chunks.

    The driver lists the names, as for any scan; footers are read in as many tasks as there are ``files_per_task`` files.
    """
    files = spark.read.parquet(path).inputFiles()
    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, -(-len(files) // files_per_task))).mapInArrow(_read, _FOOTER)


def file_profile(spark: SparkSession, datasets: Mapping[str, str]) -> DataFrame:
    """One row per column of each dataset (a name and a path): dataset, n_rows, files, row_groups, bytes, position,
    column_name, column_type."""
    parts = []
    for name, path in datasets.items():
        fields = [
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"))
            for i, f in enumerate(spark.read.parquet(path).schema.fields, start=1)
        ]
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "row_groups", "bytes")]
        counted = footers(spark, path).agg(F.count(F.lit(1)).alias("files"), *sums)
        parts.append(counted.select(F.lit(name).alias("dataset"), "n_rows", "files", "row_groups", "bytes", F.inline(F.array(*fields))))
    return reduce(DataFrame.unionByName, parts)
