"""Checks on a joined feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.scalars import day_number, utc_day
from tidemark.operators.trailing import Feed


def row_parity(source: DataFrame, joined: DataFrame) -> DataFrame:
    """(source_rows, joined_rows) in one row, as two scalar subqueries."""
    rows = F.count(F.lit(1))
    return source.sparkSession.range(1).select(
        source.agg(rows).scalar().alias("source_rows"),
        joined.agg(rows).scalar().alias("joined_rows"),
    )


def spot_check(
    joined: DataFrame,
    daily: DataFrame,
    entity_value: str,
    value: str,
    source: str,
    days: int,
    order_by: Sequence[str],
    entity: str = "repo_name",
    at: str = "issue_created_at",
    rows: int = 5,
) -> DataFrame:
    """The first ``rows`` records of one entity with the joined sum beside a recomputed one.

    The recompute works from the raw daily rows of that entity and looks up the days of the
    reported windows only: at most ``rows`` x ``days`` of them.
    """
    top = joined.where(F.col(entity) == entity_value).orderBy(*order_by).limit(rows)
    top = top.withColumn("_day", day_number(utc_day(at)))
    active = F.explode(F.sequence(F.col("_day") - days, F.col("_day") - 1)).alias("_active")
    wanted = top.select("_day").distinct().select("_day", active)
    raw = daily.where(F.col(entity) == entity_value).select(
        day_number(F.col("date")).alias("_active"), F.col(source).alias("_value")
    )
    manual = raw.join(F.broadcast(wanted), "_active").groupBy("_day").agg(F.sum("_value").alias("_manual"))
    return top.join(F.broadcast(manual), "_day", "left").select(
        *order_by,
        F.col(value).alias("stored"),
        F.coalesce("_manual", F.lit(0)).alias("counted_again"),
    )


def signal_zero_fraction(joined: DataFrame, signals: Sequence[str], alarm: float = fixed.ZERO_ALARM) -> DataFrame:
    """(signal, frac_zero, mean, alarm): share of exact zeros and mean; alarm above the given share.

    One pass and one aggregate row; the row is then turned on its side.
    """
    share = {s: F.count_if(F.col(s) == 0) / F.count(F.lit(1)) for s in signals}
    row = joined.agg(
        *[share[s].alias(f"zero_{s}") for s in signals], *[F.avg(s).alias(f"mean_{s}") for s in signals]
    )
    lines = [
        F.struct(
            F.lit(s).alias("signal"),
            F.round(F.col(f"zero_{s}"), 3).alias("frac_zero"),
            F.round(F.col(f"mean_{s}"), 1).alias("mean"),
            (F.col(f"zero_{s}") > alarm).alias("alarm"),
        )
        for s in signals
    ]
    return row.select(F.inline(F.array(*lines)))


def leakage(
    stored: DataFrame, feeds: Sequence[Feed], entity: str = "repo_name", at: str = "issue_created_at"
) -> DataFrame:
    """Leak check of a stored feature table, one row per sum: (signal, active_rows, min_lag, max_lag, leaks).

    Each sum is counted again from the raw daily rows, over the days that lie 1 to n days before the record's own
    day, by an equi-join on the day and without the window operator. A stored value that differs, because a day too
    many or too few went into it, is a leak; lags tell how near and how far the days lie that had activity.

    All sums are counted in one pass: every distinct (entity, day) of the records becomes as many rows as the longest
    window has days, the feeds are added up by day into one table, and a shorter window takes its share of the lags.
    """
    own = day_number(utc_day(at))
    sums = [(feed, m) for feed in feeds for m in feed.measures if m.how == "sum"]
    daily = None
    for feed in feeds:
        if not any(f is feed for f, _ in sums):
            continue
        rows = feed.daily.where(F.col(feed.entity).isNotNull() & F.col(feed.day).isNotNull())
        day = day_number(F.col(feed.day).cast("date")).alias("_day")
        values = [F.col(m.source).alias(m.alias) for f, m in sums if f is feed]
        active = [F.lit(True).alias(f"_on_{m.alias}") for f, m in sums if f is feed]
        part = rows.select(F.col(feed.entity).alias("_entity"), day, *values, *active)
        daily = part if daily is None else daily.unionByName(part, allowMissingColumns=True)
    daily = daily.groupBy("_entity", "_day").agg(
        *(F.sum(m.alias).alias(m.alias) for _, m in sums), *(F.max(f"_on_{m.alias}").alias(f"_on_{m.alias}") for _, m in sums)
    )
    days = stored.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    days = days.select(F.col(entity).alias("_entity"), own.alias("_own")).groupBy("_entity", "_own").agg(F.count(F.lit(1)))
    lag = F.explode(F.sequence(F.lit(1), F.lit(max(m.days for _, m in sums)))).alias("_lag")
    allowed = days.select("_entity", "_own", lag).withColumn("_day", F.col("_own") - F.col("_lag"))
    again = []
    for _, m in sums:
        inside, near = F.col("_lag") <= m.days, F.when((F.col("_lag") <= m.days) & F.col(f"_on_{m.alias}"), F.col("_lag"))
        again += [F.sum(F.when(inside, F.col(m.alias))).alias(f"_sum_{m.alias}")]
        again += [F.min(near).alias(f"_near_{m.alias}"), F.max(near).alias(f"_far_{m.alias}")]
    counted = allowed.join(daily, ["_entity", "_day"]).groupBy("_entity", "_own").agg(*again)
    records = stored.select(F.col(entity).alias("_entity"), own.alias("_own"), *(F.col(m.alias) for _, m in sums))
    checked = records.join(counted, ["_entity", "_own"], "left")
    totals = []
    for _, m in sums:
        differs = ~F.col(m.alias).eqNullSafe(F.coalesce(f"_sum_{m.alias}", F.lit(0)))
        line = [F.count(f"_near_{m.alias}").alias("active_rows"), F.min(f"_near_{m.alias}").cast("long").alias("min_lag")]
        line += [F.max(f"_far_{m.alias}").cast("long").alias("max_lag"), F.count_if(differs).alias("leaks")]
        totals.append(F.struct(F.lit(m.alias).alias("signal"), *line))
    return checked.agg(F.array(*totals).alias("lines")).select(F.inline("lines"))
