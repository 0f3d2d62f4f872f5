"""Create-or-replace tables and sharded exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark import session

#: Write options for rows of some MB each: row groups of few rows, so that neither writer nor reader holds many of them.
FEW_ROWS = {
    "compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}
#: And for rows with sparse vectors: indices as distances, a row's values mostly alike.
VECTORS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20)}


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a catalog table from a query and return it as stored."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def export_shards(
    df: DataFrame,
    path: str,
    max_records: int = 1_000_000,
    partition_by: Sequence[str] = (),
    options: dict[str, str] | None = None,
) -> None:
    """Write Parquet shards of bounded length, replacing what was there.

    The write keeps the partitioning of ``df``: no shuffle is added for it. Its own shuffle files go with it, so that
    disks hold those of one step at a time.
    """
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_records).options(**options or {})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with session.settings(df.sparkSession, session.CLEAN):
        writer.parquet(path)


def materialize(df: DataFrame, path: str, max_records: int = 1_000_000, options: dict[str, str] | None = None) -> DataFrame:
    """Write shards, then read them back: later steps start from files, not from the plan."""
    export_shards(df, path, max_records, options=options)
    spark: SparkSession = df.sparkSession
    return spark.read.schema(df.schema).parquet(path)
