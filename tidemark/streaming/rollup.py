"""The daily roll-up as a stream: a day comes out once, when the watermark says that it is over.

Sums of open days are kept in the state store. A day's rows leave it together, in the first batch whose watermark lies
beyond the day's end, and replace that day's folder; a batch that runs again after a failure replaces it by the same
rows. Rows later than that are dropped by the watermark. ``late_rows`` counts them from the raw shards, and the days it
names can be counted again in a batch (``operators.rollup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.rollup import DAY, measures, replace_days


def rolled_stream(events: DataFrame, entity: str, at: str, value: str, delay: str = "1 day") -> DataFrame:
    """(day, entity, n, total) of the days that the watermark has closed, from a stream of raw events."""
    rows = events.select(F.col(entity).alias("entity"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value"))
    rows = rows.where("at IS NOT NULL AND value IS NOT NULL").withWatermark("at", delay)
    rolled = rows.groupBy(F.window("at", "1 day").alias("w"), "entity").agg(*measures("value"))
    return rolled.select(F.to_date("w.start").alias(DAY), "entity", "n", "total")


def start_rollup(rolled: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take in all shards now present and stop; start again with the same checkpoint for those that came since."""

    def store(batch: DataFrame, batch_id: int) -> None:
        replace_days(batch, out)

    return (
        rolled.writeStream.outputMode("append")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(raw: DataFrame, closed: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """(day, arrived, counted, late) of the closed days: rows that are in the raw shards but came too late to be counted.

    A day that is closed without any row in time isn't in ``closed``; it is listed if it lies before the last closed day.
    """
    known = raw.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    arrived = known.groupBy(F.to_date(F.col(at).cast("timestamp")).alias(DAY)).agg(F.count(F.lit(1)).alias("arrived"))
    counted = closed.groupBy(DAY).agg(F.sum("n").alias("counted"))
    last = closed.agg(F.max(DAY)).scalar()
    joined = arrived.where(F.col(DAY) <= last).join(counted, DAY, "left")
    counted = F.coalesce("counted", F.lit(0))
    return joined.select(DAY, "arrived", counted.alias("counted"), (F.col("arrived") - counted).alias("late"))


def shard_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema
