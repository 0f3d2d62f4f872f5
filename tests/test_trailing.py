import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.trailing import Feed, Measure, activity_feed, signal_feeds, trailing_features
from tidemark.plans import feature_table
from tidemark.sources import star

DAY = dt.date(2025, 6, 15)
ISSUE = "repo_name string, issue_created_at timestamp, n int"


def at(day=DAY, hour=12):
    return dt.datetime(day.year, day.month, day.day, hour)


def before(n):
    return DAY - dt.timedelta(days=n)


def issues(spark, *rows):
    return spark.createDataFrame(list(rows), ISSUE)


def pushes(spark, *rows):
    return spark.createDataFrame(list(rows), "repo_name string, date date, push_count bigint")


def sums(spark, issue_rows, push_rows, days=30, dedupe_keys=True):
    feed = Feed(pushes(spark, *push_rows), (Measure("push_count", "sum", days, "total"),))
    found = trailing_features(issues(spark, *issue_rows), [feed], dedupe_keys=dedupe_keys)
    return [r.total for r in found.orderBy("n").collect()]


def means(spark, issue_rows, merge_rows):
    daily = spark.createDataFrame(merge_rows, "repo_name string, date date, hours double")
    feed = Feed(daily, (Measure("hours", "avg", 30, "mean"),))
    return [r["mean"] for r in trailing_features(issues(spark, *issue_rows), [feed]).orderBy("n").collect()]


def test_window_edges(spark):
    rows = [("r", before(31), 1), ("r", before(30), 10), ("r", before(1), 100), ("r", DAY, 1000)]
    assert sums(spark, [("r", at(), 0)], rows) == [110]


def test_long_window_edge(spark):
    rows = [("r", before(91), 1), ("r", before(90), 10)]
    assert sums(spark, [("r", at(), 0)], rows, days=90) == [10]


def test_no_activity(spark):
    assert sums(spark, [("r", at(), 0)], [("other", before(1), 5)]) == [0]
    assert means(spark, [("r", at(), 0)], [("other", before(1), 5.0)]) == [None]


def test_mean_is_of_daily_means(spark):
    assert means(spark, [("r", at(), 0)], [("r", before(1), 10.0), ("r", before(2), 20.0)]) == [15.0]


def test_mean_counts_duplicate_days_row_wise_and_skips_null(spark):
    rows = [("r", before(1), 10.0), ("r", before(1), 30.0), ("r", before(2), 50.0), ("r", before(3), None)]
    assert means(spark, [("r", at(), 0)], rows) == [30.0]


def test_shared_key_counts_double_only_without_dedupe(spark):
    twice = [("r", at(), 0), ("r", at(), 1)]
    assert sums(spark, twice, [("r", before(1), 5)], dedupe_keys=False) == [10, 10]
    assert sums(spark, twice, [("r", before(1), 5)]) == [5, 5]


def test_same_day_other_time_is_not_a_shared_key(spark):
    pair = [("r", at(hour=1), 0), ("r", at(hour=2), 1)]
    for dedupe_keys in (True, False):
        assert sums(spark, pair, [("r", before(1), 5)], dedupe_keys=dedupe_keys) == [5, 5]


@pytest.mark.parametrize("dedupe_keys", [True, False])
def test_null_entity_and_null_time_keep_their_rows(spark, dedupe_keys):
    rows = [(None, at(), 0), ("r", None, 1), ("r", at(), 2)]
    assert sums(spark, rows, [(None, before(1), 7), ("r", before(1), 5)], dedupe_keys=dedupe_keys) == [0, 0, 5]


def test_string_timestamps(spark):
    frame = spark.createDataFrame([("r", "2025-06-15T00:00:00Z", 0)], "repo_name string, issue_created_at string, n int")
    feed = Feed(pushes(spark, ("r", before(1), 5), ("r", DAY, 9)), (Measure("push_count", "sum", 30, "total"),))
    assert trailing_features(frame, [feed]).first()["total"] == 5


def test_unknown_aggregate_is_refused():
    with pytest.raises(ValueError, match="median"):
        Measure("x", "median", 30, "y")


def _rows(df):
    rounded = df.select("issue_id", *[F.round(c, 6) if "avg" in c else c for c in df.columns if c[-1] == "d" and c != "issue_id"])
    return sorted(map(tuple, rounded.collect()))


@pytest.mark.parametrize("dedupe_keys", [True, False])
def test_layout_does_not_matter(spark, sf_dir, dedupe_keys):
    base = star.issues(spark, sf_dir)
    feeds = signal_feeds(*star.daily_tables(spark, sf_dir))
    one = trailing_features(base.repartition(1), feeds, dedupe_keys=dedupe_keys)
    many = trailing_features(base.repartition(13), feeds, dedupe_keys=dedupe_keys)
    assert _rows(one) == _rows(many)


def test_build_table_checks_parity(spark, sf_dir, tmp_path):
    stored = feature_table.build_table(
        star.issues(spark, sf_dir), *star.daily_tables(spark, sf_dir), path=str(tmp_path / "t"), max_records=400
    )
    assert stored.count() == star.issues(spark, sf_dir).count()
    assert len(stored.inputFiles()) >= 4  # 1,500 rows in shards of at most 400


def test_leaks_are_reported(spark, sf_dir):
    """A feature that takes in its own day, and one that misses a day, are both found."""
    base, feeds = star.issues(spark, sf_dir), signal_feeds(*star.daily_tables(spark, sf_dir))
    good = trailing_features(base, feeds)
    assert {r.leaks for r in quality.leakage(good, feeds).collect()} == {0}
    late = feeds[1].daily.withColumn("date", F.date_add("date", -1))
    leaky = trailing_features(base, [feeds[0], Feed(late, feeds[1].measures), *feeds[2:]])
    found = {r.signal: r.leaks for r in quality.leakage(leaky, feeds).collect()}
    assert found.pop("push_count_30d") > 0 and set(found.values()) == {0}


def test_lost_rows_are_reported(spark, sf_dir):
    base = star.issues(spark, sf_dir)
    parity = quality.row_parity(base, base.where("issue_id <> 1")).first()
    assert parity.source_rows == parity.joined_rows + 1


def test_one_read_of_the_activity_gives_the_same(spark, sf_dir):
    base = star.issues(spark, sf_dir)
    one = trailing_features(base, [activity_feed(star.activity_daily(spark, sf_dir))], dedupe_keys=False)
    four = trailing_features(base, signal_feeds(*star.daily_tables(spark, sf_dir)), dedupe_keys=False)
    assert _rows(one) == _rows(four)
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("l_shipdate") and "ReusedExchange" in plan


def test_hot_entity_is_split_at_run_time(spark):
    """A third of all issues in one repository, on one day: the wide side's partition is split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    saved = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.col("id") % 3 == 0
        frame = spark.range(0, 60_000, 1, 16).select(
            F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 5000)).alias("repo_name"),
            F.timestamp_seconds(F.unix_seconds(F.lit(at())) + F.col("id") % 1).alias("issue_created_at"),
            F.sha2(F.col("id").cast("string"), 512).alias("body"),
        )
        feed = Feed(pushes(spark, ("hot", before(1), 5)), (Measure("push_count", "sum", 30, "total"),))
        for dedupe_keys, per_issue in ((True, 5), (False, 5 * 20_000)):
            joined = trailing_features(frame, [feed], dedupe_keys=dedupe_keys)
            assert sum(r.total for r in joined.collect()) == 20_000 * per_issue
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan, plan
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
