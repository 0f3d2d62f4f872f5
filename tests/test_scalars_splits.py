import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scalars
from tidemark.operators import sampling, splits, weights
from tidemark.plans import sampled
from tidemark.sources import star


def test_issue_text_keeps_the_blank(spark):
    df = spark.createDataFrame([(None, None), ("a", None), (None, "b")], "t string, b string")
    assert [r[0] for r in df.select(scalars.issue_text(F.col("t"), F.col("b"))).collect()] == [" ", "a ", " b"]


def test_author_flags(spark):
    df = spark.createDataFrame([(None,), ("owner",), ("FIRST_TIMER",)], "a string")
    rows = [tuple(r) for r in df.select(*scalars.author_flags(F.col("a"))).collect()]
    assert rows == [(0, 0, 0, 1, 0), (0, 0, 0, 0, 1), (0, 0, 0, 0, 0)]


def test_signal_log(spark):
    df = spark.createDataFrame([(0,), (None,), (9,)], "s bigint")
    got = [r[0] for r in df.select(F.round(scalars.signal_log(F.col("s")), 6)).collect()]
    assert got == [0.0, 0.0, 2.302585]


def test_bad_label_is_named(spark):
    df = spark.createDataFrame([("Fast",), ("Unknown",)], "label string")
    with pytest.raises(Exception, match="unknown label: Unknown"):
        scalars.require_labels(df).collect()


def test_label_ids_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in fixed.LABELS], "label string")
    ids = df.select("label", scalars.label_id(F.col("label")).alias("i"))
    rows = ids.select("i", scalars.label_name(F.col("i")).alias("back"), "label").orderBy("i").collect()
    assert [(r.i, r.back) for r in rows] == list(enumerate(fixed.LABELS))


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([5.0, 1.0, 2.0],)], "s array<double>")
    assert [r[0] for r in df.select(scalars.argmax(F.col("s"))).collect()] == [1, 0]


def test_row_without_a_weight_fails_by_name(spark):
    df = spark.createDataFrame([("Fast",), ("Odd",)], "label string")
    with pytest.raises(Exception, match="no weight for label: Odd"):
        weights.with_class_weight(df, weights.class_weights(df)).collect()


EDGES = ["2025-07-31 23:59:59", "2025-08-01 00:00:00", "2025-10-31 23:59:59", "2025-11-01 00:00:00", None]


@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz"])
def test_split_edges(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    df = df.select("i", F.col("t").cast(kind).alias("issue_created_at"))
    named = [r.split for r in splits.with_split(df).orderBy("i").collect()]
    assert named == ["train", "test", "test", "discard", "discard"]
    assert [r.i for r in splits.train_rows(df).collect()] == [0]
    assert sorted(r.i for r in splits.test_rows(df).collect()) == [1, 2]


def test_split_filter_reaches_the_scan(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders")
    train = splits.train_rows(orders, at="o_orderdate", train_end=star.TRAIN_END)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in plan


def test_class_weight_identity(spark, sf_dir):
    rows = weights.class_weights(star.issues(spark, sf_dir)).collect()
    assert abs(sum(1 / (4 * r.weight) for r in rows) - 1) < 1e-12


def test_published_rates_and_weights(spark):
    counts = {"Fast": 260_435, "Medium": 62_475, "Slow": 44_366, "Stale": 131_971}
    df = spark.createDataFrame(list(counts.items()), "label string, n int")
    df = df.select("label", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    got = {r.label: round(r.weight, 2) for r in weights.class_weights(df).collect()}
    assert got == {"Fast": 0.48, "Medium": 2.0, "Slow": 2.81, "Stale": 0.95}


def test_sampling_rate_is_capped(spark, sf_dir):
    small = star.issues(spark, sf_dir)
    assert {r.rate for r in sampling.sampling_rates(small, target=10**9).collect()} == {1.0}
    assert sampling.stratified_sample(small, "issue_id", target=10**9).count() == small.count()


def test_sample_does_not_depend_on_layout(spark, sf_dir):
    base = star.issues(spark, sf_dir)
    ids = lambda df: sorted(r.issue_id for r in sampling.stratified_sample(df, "issue_id", 500).collect())
    assert ids(base) == ids(base.repartition(11))
    assert 400 < len(ids(base)) < 600


def test_holdout_reads_the_written_sample_only(spark, sf_dir):
    parts = sampled.sampled_parts(splits.train_rows(star.issues(spark, sf_dir), train_end=star.TRAIN_END), "issue_id", 500)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "sample-" in plan and "orders.parquet" not in plan


@pytest.mark.parametrize("n, size", [(100, 99), (400, 399), (501, 500), (7_000, 700), (1, 0)])
def test_holdout_size(spark, n, size):
    df = splits.with_holdout(spark.range(n).withColumnRenamed("id", "k"), "k")
    assert df.where("part = 'val'").count() == size
    assert df.count() == n


def test_holdout_takes_the_end_of_the_shuffle(spark):
    import hashlib

    n = 6_000
    df = splits.with_holdout(spark.range(n).repartition(7), "id")
    got = {r.id for r in df.where("part = 'val'").collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"shuffle:42:{i}".encode()).hexdigest())
    assert got == set(order[-600:])


def test_instant_reads_text_and_refuses_junk(spark):
    df = spark.createDataFrame([("2025-08-01T03:00:00+03:00",)], "t string")
    assert df.select(F.unix_seconds(scalars.instant("t"))).first()[0] == int(
        dt.datetime(2025, 8, 1, tzinfo=dt.timezone.utc).timestamp()
    )
    bad = spark.createDataFrame([("soon",)], "t string")
    with pytest.raises(Exception):
        bad.select(scalars.instant("t")).collect()
    assert bad.select(scalars.instant("t", strict=False)).first()[0] is None
