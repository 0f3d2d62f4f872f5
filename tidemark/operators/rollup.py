"""Daily roll-ups of raw events, kept by day so that late rows rewrite only the days they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "day"


def measures(value: str) -> list[Column]:
    """Count and sum of a day; a day without a value has the sum NULL."""
    return [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")]


def with_mean(rolled: DataFrame) -> DataFrame:
    """Add the mean per row that has a value, from counts and sums, which can be added up further."""
    return rolled.withColumn("mean", F.col("total") / F.col("n"))


def daily_rollup(events: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """(day, entity, n, total) over UTC days. Rows without an instant belong to no day and are left out, as are rows
    without a value; a null entity is a group of its own. Partial sums are made before the one narrow shuffle."""
    known = events.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(F.to_date(at).alias(DAY), entity).agg(*measures(value))


def replace_days(rolled: DataFrame, path: str) -> None:
    """Write the days of ``rolled``, one folder a day; folders of other days are not touched.

    A day's rows come together in as many files as their size asks for. Writing the same rows again changes nothing, so
    a job that was broken off can be run again.
    """
    laid_out = rolled.hint("rebalance", DAY)
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def stored_days(spark: SparkSession, path: str, entity: T.DataType) -> DataFrame:
    """The table that ``replace_days`` wrote; a filter on the day reads that day's folder only."""
    schema = T.StructType(
        [
            T.StructField("entity", entity),
            T.StructField("n", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField(DAY, T.DateType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)


class DailyStore:
    """Raw events and their daily roll-up under one folder: ``raw/batch=.../day=...`` and ``daily/day=...``.

    A batch goes into a raw folder of its own, so that taking it in twice replaces it. The days it touches are counted
    again from all raw rows of those days and replace the stored ones; whatever the batch's order of arrival, the table
    is the roll-up of all batches.
    """

    def __init__(self, spark: SparkSession, path: str, entity: str, at: str, value: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.entity, self.at, self.value = entity, at, value

    @property
    def raw_path(self) -> str:
        return f"{self.path}/raw"

    @property
    def daily_path(self) -> str:
        return f"{self.path}/daily"

    def _narrow(self, events: DataFrame) -> DataFrame:
        entity, at = F.col(self.entity).alias("entity"), F.col(self.at).cast("timestamp").alias("at")
        rows = events.select(entity, at, F.col(self.value).cast("double").alias("value"))
        return rows.where("at IS NOT NULL AND value IS NOT NULL").withColumn(DAY, F.to_date("at"))

    def raw(self, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.raw_path)

    def take_in(self, events: DataFrame, batch: int) -> list:
        """Add a batch and renew the days it touches; returns them. Their number is what the driver sees."""
        rows = self._narrow(events)
        folder = f"{self.raw_path}/batch={batch}"
        rows.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(folder)
        kept = T.StructType([f for f in rows.schema if f.name != DAY] + [T.StructField(DAY, T.DateType())])
        days = [r[0] for r in self.spark.read.schema(kept).parquet(folder).select(DAY).distinct().orderBy(DAY).collect()]
        self.renew(days, kept)
        return days

    def renew(self, days: list, schema: T.StructType) -> None:
        """Count ``days`` again from the raw rows; only their folders are read and written."""
        if days:
            touched = self.raw(schema).where(F.col(DAY).isin(days))
            replace_days(touched.groupBy(DAY, "entity").agg(*measures("value")), self.daily_path)

    def daily(self, entity: T.DataType) -> DataFrame:
        return stored_days(self.spark, self.daily_path, entity)
