"""Trailing-window feature join: for each record, totals of the days before its own day.

The window of length n for a record of day D is [D - n, D - 1]. It depends on the day only, so
the work is done once per (entity, day) and never per record:

1. Record days and all daily feeds are stacked and pre-aggregated to one row per (entity, day).
   Partial aggregation runs before the shuffle, so an entity with a third of all records sends
   each of its days once per map task.
2. A range frame over the day axis gives every window. An entity has at most one row per
   calendar day here, whatever its traffic, so no window task can grow with the data volume,
   and a frame holds at most n rows.
3. The features go back to the records with one equi-join. Only this join moves the wide rows.
   Its left side may be skewed; adaptive execution splits such partitions of a left outer join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.scalars import day_number, utc_day

_DAY = "_day"
_COPIES = "_copies"
_WANTED = "_wanted"


@dataclass(frozen=True)
class Measure:
    """One output column: ``how`` (sum, avg, first_day, last_day) of ``source`` over ``days`` days."""

    source: str
    how: str
    days: int
    alias: str

    def __post_init__(self) -> None:
        if self.how not in ("sum", "avg", "first_day", "last_day"):
            raise ValueError(f"unknown aggregate: {self.how}")
        if self.days < 1:
            raise ValueError("a window has at least one day")

    @property
    def total(self) -> str:
        return f"_total_{self.alias}"

    @property
    def count(self) -> str:
        return f"_count_{self.alias}"

    def daily_columns(self) -> list[Column]:
        """What one feed row contributes."""
        if self.how in ("first_day", "last_day"):
            return [F.col(_DAY).alias(self.total)]
        value = F.col(self.source)
        columns = [value.alias(self.total)]
        if self.how == "avg":
            columns.append(value.isNotNull().cast("long").alias(self.count))
        return columns

    def daily_totals(self) -> list[Column]:
        """Several feed rows of one day become one."""
        merge = {"first_day": F.min, "last_day": F.max}.get(self.how, F.sum)
        columns = [merge(self.total).alias(self.total)]
        if self.how == "avg":
            columns.append(F.sum(self.count).alias(self.count))
        return columns

    def over(self, entity: str) -> Column:
        frame = Window.partitionBy(entity).orderBy(_DAY).rangeBetween(-self.days, -1)
        if self.how == "first_day":
            return F.min(self.total).over(frame).alias(self.alias)
        if self.how == "last_day":
            return F.max(self.total).over(frame).alias(self.alias)
        total = F.sum(self.total).over(frame)
        if self.how == "sum":
            return total.alias(self.alias)
        # Row-wise mean of the feed's values: NULL when the window has none.
        return F.try_divide(total.cast("double"), F.sum(self.count).over(frame)).alias(self.alias)


@dataclass(frozen=True)
class Feed:
    """A daily table and the measures to take from it."""

    daily: DataFrame
    measures: tuple[Measure, ...]
    entity: str = "repo_name"
    day: str = "date"


def signal_feeds(pr: DataFrame, push: DataFrame, release: DataFrame, watch: DataFrame) -> list[Feed]:
    """The four repository feeds and their five signals."""
    short, long = fixed.SHORT_WINDOW_DAYS, fixed.LONG_WINDOW_DAYS
    return [
        Feed(
            pr,
            (
                Measure("pr_merged_count", "sum", short, "pr_merged_30d"),
                Measure("avg_hours_to_merge", "avg", short, "avg_merge_hours_30d"),
            ),
        ),
        Feed(push, (Measure("push_count", "sum", short, "push_count_30d"),)),
        Feed(release, (Measure("release_count", "sum", long, "release_count_90d"),)),
        Feed(watch, (Measure("star_count", "sum", short, "star_count_30d"),)),
    ]


def activity_feed(daily: DataFrame) -> Feed:
    """The same five signals from one daily table that has the columns of all four."""
    parts = signal_feeds(daily, daily, daily, daily)
    return Feed(daily, tuple(m for part in parts for m in part.measures))


def _measures(feeds: Sequence[Feed]) -> list[Measure]:
    return [m for feed in feeds for m in feed.measures]


def window_features(days: DataFrame, feeds: Sequence[Feed], entity: str) -> DataFrame:
    """One row per distinct (entity, day number) of ``days``, with every measure.

    ``days`` may bring ``_copies``, the records behind each of its rows; a day is wanted if it has any.
    """
    copies = F.col(_COPIES) if _COPIES in days.columns else F.lit(1).cast("long")
    stacked = [days.select(entity, _DAY, copies.alias(_WANTED))]
    for feed in feeds:
        keyed = feed.daily.where(F.col(feed.entity).isNotNull() & F.col(feed.day).isNotNull())
        keyed = keyed.withColumn(_DAY, day_number(F.col(feed.day).cast("date")))
        columns = [c for m in feed.measures for c in m.daily_columns()]
        stacked.append(keyed.select(F.col(feed.entity).alias(entity), _DAY, *columns))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)

    measures = _measures(feeds)
    per_day = union.groupBy(entity, _DAY).agg(
        F.sum(_WANTED).alias(_WANTED), *[c for m in measures for c in m.daily_totals()]
    )
    windowed = per_day.select(entity, _DAY, _WANTED, *[m.over(entity) for m in measures])
    return windowed.where(F.col(_WANTED) > 0).drop(_WANTED)


def trailing_features(
    records: DataFrame,
    feeds: Sequence[Feed],
    entity: str = "repo_name",
    at: str = "issue_created_at",
    dedupe_keys: bool = True,
) -> DataFrame:
    """Records with one more column per measure; the row count does not change.

    Sums are 0 and averages NULL where the window is empty. A NULL entity matches nothing.

    ``dedupe_keys=False`` gives what a join of the raw records before grouping by
    (entity, timestamp) gives: when m records share both, each of their sums counts m times.
    """
    measures = _measures(feeds)
    day = day_number(utc_day(at))
    known = records.where(F.col(entity).isNotNull() & F.col(at).isNotNull())

    if dedupe_keys:
        features = window_features(known.select(entity, day.alias(_DAY)), feeds, entity)
        keyed, keys = records.withColumn(_DAY, day), [entity, _DAY]
    else:
        moments = known.groupBy(entity, at).agg(F.count(F.lit(1)).alias(_COPIES)).withColumn(_DAY, day)
        scaled = [
            (F.col(m.alias) * F.col(_COPIES)).alias(m.alias) if m.how == "sum" else F.col(m.alias)
            for m in measures
        ]
        # Both uses of the aggregate need the same columns, so that one exchange serves them.
        per_day = window_features(moments.select(entity, _DAY, _COPIES), feeds, entity)
        features = moments.join(per_day, [entity, _DAY], "left").select(entity, at, *scaled)
        keyed, keys = records, [entity, at]

    filled = [
        F.coalesce(F.col(m.alias), F.lit(0)).alias(m.alias) if m.how == "sum" else F.col(m.alias)
        for m in measures
    ]
    return keyed.join(features, keys, "left").select(*[F.col(c) for c in records.columns], *filled)
