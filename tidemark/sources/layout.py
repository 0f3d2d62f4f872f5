"""Tables laid out for reuse: partitioned by month, and bucketed by the keys they are joined on."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"


def write_laid_out(df: DataFrame, name: str, day: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as table ``name`` with a folder per month of ``day`` and ``buckets`` files in each.

    Rows of one bucket are written by one task, so that a month has a file a bucket however many tasks there are. Tables
    with the same keys and buckets join on exactly these keys without moving, as often as they are read. Choose keys of
    which none holds a large share of the rows, such as (repository, day): a bucket is one task of a join. Rows without a
    day go to a month of their own. ``path`` puts the files there; else they lie in the warehouse.
    """
    placed = df.withColumn(MONTH, F.trunc(F.col(day).cast("date"), "month"))
    writer = placed.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(MONTH).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def months(table: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows with ``start`` <= day < ``end`` (dates); folders of other months are not opened."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    inside = (F.col(MONTH) >= F.lit(first.replace(day=1))) & (F.col(MONTH) <= F.lit(last.replace(day=1)))
    at = F.col(day).cast("date")
    return table.where(inside & (at >= F.lit(first)) & (at < F.lit(last)))


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
