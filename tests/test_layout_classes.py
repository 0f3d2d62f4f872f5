"""Stored layouts, footers, checks in the write's own pass, duration classes and the tree model."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import durations
from tidemark.plans import feature_table, trees
from tidemark.sources import footers, layout, star, tables


@pytest.fixture
def stored(spark, tmp_path):
    """Two tables of 400 days and 6 keys, laid out alike."""
    stamp = uuid.uuid4().hex
    rows = spark.range(2400).selectExpr("id", "concat('r', id % 6) as repo", "date_add(date'2024-01-01', cast(id % 400 as int)) as day")
    rows = rows.union(rows.limit(1).selectExpr("-1L", "repo", "cast(null as date)"))
    sums = rows.where("day is not null").groupBy("repo", "day").agg(F.count("*").alias("n"))
    names = [f"t_a_{stamp}", f"t_b_{stamp}"]
    made = [layout.write_laid_out(df, n, "day", ["repo", "day"], 4, str(tmp_path / n)) for df, n in zip((rows, sums), names, strict=True)]
    yield made
    layout.drop_tables(spark, *names)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_laid_out_tables_join_without_moving(spark, stored):
    a, b = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(a.join(b.drop(layout.MONTH), ["repo", "day"], "left"))
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert a.count() == 2401 and a.join(b.drop(layout.MONTH), ["repo", "day"]).count() == 2400


def test_only_asked_months_are_opened(spark, stored):
    found = layout.months(stored[0], "day", "2024-03-10", "2024-05-02")
    files = {f.split("month=")[1][:7] for f in stored[0].inputFiles() if "month=2" in f}
    assert len(files) == 14
    row = found.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    assert (row.a.isoformat(), row.b.isoformat()) == ("2024-03-10", "2024-05-01")
    assert "PartitionFilters: [isnotnull(month" in plan_of(found)
    opened = found.select("_metadata.file_path").distinct().collect()
    assert {r.file_path.split("month=")[1][:7] for r in opened} == {"2024-03", "2024-04", "2024-05"}


def test_a_month_has_a_file_a_bucket(stored):
    per = {}
    for f in stored[0].inputFiles():
        per[f.split("month=")[1].split("/")[0]] = per.get(f.split("month=")[1].split("/")[0], 0) + 1
    assert max(per.values()) <= 4 and len(per) == 15


def test_footers_count_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.export_shards(spark.range(5000).selectExpr("id", "cast(id as string) as s").repartition(3), path, max_records=1000)
    found = footers.footers(spark, path, files_per_task=2)
    assert found.agg(F.sum("n_rows")).first()[0] == 5000 and found.where("row_groups < 1 or bytes <= 0").isEmpty()
    profile = footers.file_profile(spark, {"t": path, "u": path})
    rows = {(r.dataset, r.position): r for r in profile.collect()}
    assert set(rows) == {(d, i) for d in "tu" for i in (1, 2)}
    assert rows["t", 2].column_name == "s" and rows["t", 2].column_type == "string" and rows["t", 1].files == found.count() >= 6
    assert "parquet" not in profile._jdf.queryExecution().executedPlan().toString().lower()


def test_zeros_and_rows_are_counted_in_one_narrow_pass(spark, sf_dir, tmp_path):
    inputs = [star.issues(spark, sf_dir), *star.daily_tables(spark, sf_dir)]

    def jobs(group, run):
        spark.sparkContext.setJobGroup(group, group)
        try:
            out = run()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    plain, n_plain = jobs("plain", lambda: (tables.materialize(feature_table.issues_with_signals(*inputs), str(tmp_path / "a")), inputs[0].count()))
    built, n_built = jobs("checked", lambda: feature_table.build_checked(*inputs, path=str(tmp_path / "b")))
    assert n_built <= n_plain + 2  # one aggregate more, in two stages
    assert built.source_rows == built.joined_rows == plain[1]
    want = {r.signal: r.frac_zero for r in feature_table.zero_report(built.stored).collect()}
    assert {s: round(v, 3) for s, v in built.zero_shares.items()} == pytest.approx(want)
    assert set(built.alarms) == {r.signal for r in feature_table.zero_report(built.stored).collect() if r.alarm}


def test_duration_classes(spark):
    rows = [
        (1, "2024-01-01 00:00", "2024-01-01 10:00", 10.0, "Fast"),
        (2, "2024-01-01 00:00", "2024-01-02 00:00", 24.0, "Fast"),
        (3, "2024-01-01 00:00", "2024-01-02 00:01", 24 + 1 / 60, "Medium"),
        (4, "2024-01-01 00:00", "2024-01-09 00:00", 192.0, "Stale"),
        (5, "2024-01-01 00:00", None, None, "Stale"),  # open, older than the last threshold
        (6, "2024-01-18 00:00", None, None, None),  # open and young
        (7, "2024-01-18 00:00", "2024-01-25 00:00", None, None),  # closed later than seen
        (8, "2024-01-18 00:00", "2024-01-18 06:00", 6.0, "Fast"),
        (9, "2024-01-30 00:00", None, None, None),  # opened later than seen
        (10, "2024-01-03 00:00", "2024-01-02 00:00", None, None),  # closed before opened
        (11, None, "2024-01-02 00:00", None, None),
        (12, None, None, None, None),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "i int, opened string, closed string")
    frame = frame.withColumns({c: F.col(c).cast("timestamp") for c in ("opened", "closed")})
    got = durations.with_duration_class(frame, "opened", "closed", (24, 72, 168), "2024-01-20")
    for r, want in zip(got.orderBy("i").collect(), rows, strict=True):
        assert r.label == want[4] and r.mature == (want[4] is not None)
        assert r.duration_hours == (pytest.approx(want[3]) if want[3] is not None else None)
    with pytest.raises(ValueError):
        durations.with_duration_class(frame, "opened", "closed", (24, 12, 168), "2024-01-20")
    with pytest.raises(ValueError):
        durations.with_duration_class(frame, "opened", "closed", (24,), "2024-01-20")


def test_thresholds_come_from_closed_records(spark):
    frame = spark.range(1, 1001).selectExpr("timestamp_seconds(0) as opened", "if(id % 5 = 0, null, timestamp_seconds(id * 3600)) as closed")
    hours = sorted(i for i in range(1, 1001) if i % 5)
    got = durations.fitted_thresholds(frame, "opened", "closed", (0.25, 0.5, 0.75))
    assert got == [float(hours[int(s * 800) - 1]) for s in (0.25, 0.5, 0.75)]
    with pytest.raises(ValueError):
        durations.fitted_thresholds(frame.where("closed is null"), "opened", "closed", (0.5,))


def test_trees_learn_what_no_line_divides(spark):
    rows = spark.range(600).selectExpr(
        "id as issue_id", "if(id % 2 = 0, 'OWNER', null) as author_association", "cast((id * 37) % 100 as long) as star_count_30d",
        "cast(id % 7 as long) as pr_merged_30d", "cast(null as double) as avg_merge_hours_30d", "0L as push_count_30d", "3L as release_count_90d",
    )
    label = F.when((F.col("star_count_30d") > 50) == (F.col("author_association").isNotNull()), "Fast").otherwise("Slow")
    rows = rows.withColumn("label", label)
    model = trees.fit_trees(rows.where("issue_id < 450"), trees.TreeSpec(rounds=3, depth=3, labels=("Fast", "Slow")))
    pairs = model.predict(rows.where("issue_id >= 450"), ["issue_id"])
    assert pairs.columns == ["issue_id", "true_label", "pred_label"] and pairs.count() == 150
    assert pairs.where("true_label = pred_label").count() >= 140
    names = dict(model.importances())
    assert set(names) == set(trees.FEATURES) and sum(names.values()) == pytest.approx(1)
    assert {model.importances()[0][0], model.importances()[1][0]} <= {"log_star_count_30d", "is_owner", "is_none"}
