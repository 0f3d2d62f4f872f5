"""Trailing windows finer than a day: sums over the hours (or minutes) before a record, for entities of any size.

A range frame over an entity needs all of the entity's rows in one task. Here time is cut into buckets, and a record's
frame into the part that lies in its own bucket and those before. Feed rows are copied into the buckets whose records
can see them (the halo), so that every (entity, bucket) is complete by itself and one busy entity becomes many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeMeasure:
    """``how``: sum (of ``source``) or count (``source`` unused), over ``seconds`` before the record's instant."""

    alias: str
    seconds: int
    how: str = "count"
    source: str | None = None

    def __post_init__(self) -> None:
        if self.how not in ("sum", "count") or self.seconds <= 0 or (self.how == "sum" and not self.source):
            raise ValueError(f"no such measure: {self}")


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def trailing_time(
    records: DataFrame,
    feed: DataFrame,
    measures: Sequence[TimeMeasure],
    entity: str,
    at: str,
    feed_at: str | None = None,
    feed_entity: str | None = None,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """(entity, at, measures...) for every distinct (entity, instant) of ``records``.

    A window holds the feed's rows with ``instant - seconds <= feed instant < instant`` of the same entity; the record's
    own instant is left out, so that nothing of it leaks. Sums and counts without any row are 0. Records and feed rows
    without entity or instant take no part. ``bucket_seconds`` is the grain of the tasks, by default the longest window:
    a feed row then goes to two buckets. A smaller one makes more tasks of a busy entity and more copies of feed rows.

    Feed rows of one instant are added up first. A row's value enters just after its instant and leaves after its window:
    with both as signed changes, a running sum in time order is the window's sum, in one pass however full the window is.
    """
    feed_at, feed_entity = feed_at or at, feed_entity or entity
    longest = max(m.seconds for m in measures)
    grain = bucket_seconds or longest
    copies = -(-longest // grain)
    unit = 1_000_000
    sources = sorted({m.source for m in measures if m.source})
    kinds = {m.alias: "long" if m.how == "count" else "double" for m in measures}
    bucket = F.floor(F.col("_at") / (grain * unit))

    wanted = records.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    wanted = wanted.select(F.col(entity).alias("_entity"), _micros(at).alias("_at")).distinct()
    nothing = [F.lit(0).cast(kinds[m.alias]).alias(m.alias) for m in measures]
    asked = wanted.select("_entity", bucket.alias("_bucket"), "_at", F.lit(0).alias("_kind"), *nothing)

    rows = feed.where(F.col(feed_entity).isNotNull() & F.col(feed_at).isNotNull())
    rows = rows.groupBy(F.col(feed_entity).alias("_entity"), _micros(feed_at).alias("_at"))
    rows = rows.agg(F.count(F.lit(1)).alias("_n"), *(F.sum(s).cast("double").alias(f"_s_{s}") for s in sources))
    value = {m.alias: F.col("_n") if m.how == "count" else F.coalesce(f"_s_{m.source}", F.lit(0.0)) for m in measures}

    def change(later: int, sign: int, moved: Sequence[TimeMeasure]) -> Column:
        """All values come at one instant; those of one window's length go together."""
        own = [(sign * value[m.alias] if m in moved else F.lit(0)).cast(kinds[m.alias]).alias(m.alias) for m in measures]
        return F.struct((F.col("_at") + later).alias("_at"), F.lit(1).alias("_kind"), *own)

    changes = [change(0, 1, measures)]
    changes += [change(n * unit, -1, [m for m in measures if m.seconds == n]) for n in sorted({m.seconds for m in measures})]
    seen = F.explode(F.sequence(bucket, bucket + copies)).alias("_bucket")
    given = rows.select("_entity", "_at", seen, F.array(*changes).alias("_changes"))
    given = given.select("_entity", "_bucket", F.inline("_changes"))

    own = Window.partitionBy("_entity", "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(given)
    found = both.select("_entity", "_at", "_kind", *(F.sum(m.alias).over(own).alias(m.alias) for m in measures)).where("_kind = 0")
    return found.select(F.col("_entity").alias(entity), F.timestamp_micros("_at").alias(at), *(m.alias for m in measures))


def with_trailing_time(records: DataFrame, feed: DataFrame, measures: Sequence[TimeMeasure], entity: str, at: str, **settings) -> DataFrame:
    """``records`` with the measures, every row kept; rows without entity or instant get zeros.

    The wide rows move once, in an outer join between two plain exchanges, whose hot partitions adaptive execution splits.
    """
    found = trailing_time(records, feed, measures, entity, at, **settings)
    found = found.withColumnsRenamed({entity: "_of", at: "_when"})
    same = (F.col(entity) == F.col("_of")) & (F.col(at).cast("timestamp") == F.col("_when"))
    joined = records.join(found, same, "left")
    return joined.select(*records.columns, *(F.coalesce(m.alias, F.lit(0)).alias(m.alias) for m in measures))
