"""A seeded global shuffle: every row's place in one random order, the same in every layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.sources import tables


def shuffle_digest(key: str, seed: int = fixed.SEED) -> Column:
    """What rows are ordered by: an md5 of seed and key, as in the holdout's shuffle."""
    return F.md5(F.concat(F.lit(f"shuffle:{seed}:"), F.col(key).cast("string")))


def _places(rows: DataFrame, digest: Column, key: str) -> DataFrame:
    """(key, _part, _at, _digest): rows range partitioned by digest, and their place within the partition."""
    narrow = rows.select(key, digest.alias("_digest"))
    ordered = narrow.repartitionByRange("_digest", key).sortWithinPartitions("_digest", key)
    # The lower 33 bits count the rows of a partition in their order.
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.select(key, F.spark_partition_id().alias("_part"), at.alias("_at"), "_digest")


def with_places(rows: DataFrame, key: str, seed: int = fixed.SEED) -> DataFrame:
    """(key, place): the place, from 0, of every row in the shuffled order. ``key`` must be unique and not null.

    Digests are spread evenly, so that ranges of them are even too, whatever the keys. A partition's first place is the
    number of rows in those before; of these counts, one a partition, the driver makes the running sum. Keys alone move.
    """
    spark = rows.sparkSession
    placed = tables.materialize(_places(rows, shuffle_digest(key, seed), key), session.scratch_dir(spark, "places"))
    before, first = 0, []
    for part, n in placed.groupBy("_part").agg(F.count(F.lit(1))).orderBy("_part").toLocalIterator():
        first.append((part, before))
        before += n
    begins = spark.createDataFrame(first, "_part int, _begin long")
    # One row a partition of the table written: bounded by their number, not by the rows.
    return placed.join(F.broadcast(begins), "_part").select(key, (F.col("_begin") + F.col("_at")).alias("place"))


def export_shuffled(rows: DataFrame, key: str, path: str, rows_per_shard: int, seed: int = fixed.SEED) -> DataFrame:
    """Write whole rows as shards ``shard=0``, ``shard=1``, ... of ``rows_per_shard`` consecutive places each, in order
    within a shard, and return them as stored with ``place`` and ``shard``. Training reads shard after shard."""
    spark = rows.sparkSession
    placed = rows.join(with_places(rows, key, seed), key)
    shard = F.floor(F.col("place") / rows_per_shard).cast("int").alias("shard")
    shards = placed.select("*", shard)
    shards = shards.repartition("shard").sortWithinPartitions("shard", "place")
    shards.write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)
