"""Splits by time, and an exact random holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed
from tidemark.functions.scalars import instant


def _comparable(df: DataFrame, at: str) -> Column:
    """The stored column where it is a timestamp, so that comparisons reach the scan."""
    return instant(at) if isinstance(df.schema[at].dataType, T.StringType) else F.col(at)


def _bound(df: DataFrame, at: str, value: str) -> Column:
    """A literal of the column's own type; another type would put a cast around the column."""
    kind = df.schema[at].dataType
    return F.lit(value).cast("timestamp" if isinstance(kind, T.StringType) else kind)


def train_rows(df: DataFrame, at: str = "issue_created_at", train_end: str = fixed.TRAIN_END) -> DataFrame:
    return df.where(_comparable(df, at) < _bound(df, at, train_end))


def test_rows(
    df: DataFrame,
    at: str = "issue_created_at",
    train_end: str = fixed.TRAIN_END,
    test_end: str = fixed.TEST_END,
) -> DataFrame:
    time = _comparable(df, at)
    return df.where((time >= _bound(df, at, train_end)) & (time < _bound(df, at, test_end)))


test_rows.__test__ = False


def with_split(
    df: DataFrame,
    at: str = "issue_created_at",
    train_end: str = fixed.TRAIN_END,
    test_end: str = fixed.TEST_END,
) -> DataFrame:
    """Add ``split``: train, test, or discard for later rows and rows without a time."""
    time = _comparable(df, at)
    split = (
        F.when(time < _bound(df, at, train_end), "train")
        .when(time < _bound(df, at, test_end), "test")
        .otherwise("discard")
    )
    return df.withColumn("split", split)


def holdout_size(n: Column) -> Column:
    """A tenth of the sample, at least 500 rows, and never the whole sample."""
    tenth = F.floor(n / fixed.HOLDOUT_DIVISOR)
    return F.least(F.greatest(F.lit(fixed.HOLDOUT_FLOOR), tenth), F.greatest(n - 1, F.lit(0)))


def with_holdout(sample: DataFrame, key: str, seed: int = fixed.SEED) -> DataFrame:
    """Add ``part``: val for the last rows of a seeded shuffle (``holdout_size`` of them), else train.

    ``key`` must be unique. The shuffle order is the md5 of seed and key, and no row is moved to
    find the cut: a histogram over the first four hex digits (65,536 bins at most) locates the
    bin of the cut, only that bin is ranked, and the cut comes back as a one-value subquery.

    ``sample`` is read three times: write it first. One task ranks about N / 65,536 keys and another adds up
    65,536 counts at most, which suits samples up to some billion rows.
    """
    digest = F.md5(F.concat(F.lit(f"shuffle:{seed}:"), F.col(key).cast("string")))
    places = sample.select(digest.alias("_digest"), F.substring(digest, 1, 4).alias("_bin"))

    bins = places.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    all_bins = Window.partitionBy()
    from_top = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    cut_bin = (
        bins.select(
            "_bin",
            "_n",
            F.coalesce(F.sum("_n").over(from_top), F.lit(0)).alias("_above"),
            holdout_size(F.sum("_n").over(all_bins)).alias("_size"),
        )
        .withColumn("_need", F.col("_size") - F.col("_above"))
        .where((F.col("_need") > 0) & (F.col("_need") <= F.col("_n")))
        .select("_bin", "_need")
    )
    ranked = places.join(F.broadcast(cut_bin), "_bin").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bin").orderBy(F.desc("_digest")))
    )
    cut = ranked.where(F.col("_rank") == F.col("_need")).select("_digest")
    return sample.withColumn("part", F.when(digest >= cut.scalar(), "val").otherwise("train"))
