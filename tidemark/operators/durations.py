"""Classes from the time between opening and closing, with records set apart that are too young to be judged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed


def duration_hours(opened: str, closed: str) -> Column:
    """Hours from ``opened`` to ``closed``; NULL while open, and where it closes before it opens."""
    hours = (F.unix_micros(F.col(closed).cast("timestamp")) - F.unix_micros(F.col(opened).cast("timestamp"))) / 3.6e9
    return F.when(hours >= 0, hours)


def fitted_thresholds(train: DataFrame, opened: str, closed: str, shares: Sequence[float], accuracy: int = 1_000_000) -> list[float]:
    """Hours within which the given shares of the closed records of ``train`` were closed, ascending.

    Taken from the train split alone, so that nothing of later records decides the classes. One pass; the sketch's rank
    error is 1 / ``accuracy`` of the rows. Raises if no record is closed.
    """
    found = train.agg(F.percentile_approx(duration_hours(opened, closed), list(shares), accuracy).alias("h")).first().h
    if found is None:
        raise ValueError("no closed record to take thresholds from")
    return sorted(float(h) for h in found)


def with_duration_class(
    df: DataFrame, opened: str, closed: str, thresholds: Sequence[float], as_of: str, labels: Sequence[str] = fixed.LABELS
) -> DataFrame:
    """Add duration_hours, label and mature, as seen at the instant ``as_of``.

    ``thresholds`` (hours, ascending, one less than labels) are upper ends: a record closed within the first is of the
    first class, and so on; later ones are of the last. What closed after ``as_of`` is still open then. An open record
    is of the last class once it is older than the last threshold; before, its class is not known: it is not mature, and
    its label NULL, as is that of records opened after ``as_of``, without opening time, or closed before opened.
    """
    if list(thresholds) != sorted(thresholds) or len(thresholds) != len(labels) - 1:
        raise ValueError(f"{len(labels)} labels need {len(labels) - 1} ascending thresholds")
    now = F.lit(as_of).cast("timestamp")
    start, end = F.col(opened).cast("timestamp"), F.col(closed).cast("timestamp")
    shut = end.isNotNull() & (end <= now)
    hours = F.when(shut, duration_hours(opened, closed))
    age = (F.unix_micros(now) - F.unix_micros(start)) / 3.6e9
    label = F.when(hours.isNotNull(), F.lit(labels[-1]))
    for limit, name in reversed(list(zip(thresholds, labels, strict=False))):
        label = F.when(hours <= limit, F.lit(name)).otherwise(label)
    label = F.when(start > now, None).when(shut, label).when(age > thresholds[-1], F.lit(labels[-1]))
    return df.withColumns({"duration_hours": hours, "label": label}).withColumn("mature", F.col("label").isNotNull())
