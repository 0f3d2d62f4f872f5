import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.functions.scalars import argmax, label_name
from tidemark.operators import metrics, splits
from tidemark.plans import jobs, scoring, training
from tidemark.sources import profile, shards, star, tables
from tidemark.streaming import shard_scoring


def test_missing_and_empty_folders_fail(spark, tmp_path):
    with pytest.raises(AnalysisException):
        shards.read_shards(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        shards.read_shards(spark, str(tmp_path / "empty"))


def test_smoke_read_takes_the_first_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.export_shards(spark.range(0, 700, 1, 7), path)
    assert shards.read_smoke(spark, path).count() == 300
    smoke = shards.read_smoke(spark, path, ["id"]).agg(F.max("id")).first()[0]
    assert smoke == 299


def test_pruned_read(spark, sf_dir):
    plan = shards.read_shards(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"])._jdf.queryExecution()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan.executedPlan().toString()


def test_row_ids_are_unique_and_stable(spark, tmp_path):
    path = str(tmp_path / "r")
    tables.export_shards(spark.range(0, 500, 1, 5).select(F.lit("copy").alias("v")), path)
    read = lambda: {r.row_id for r in shards.with_row_id(shards.read_shards(spark, path)).collect()}
    assert len(read()) == 500 and read() == read()


@pytest.mark.parametrize("per_file", [1_000_000, 10])
def test_smoke_read_takes_whole_shards(spark, tmp_path, per_file):
    rows = spark.range(0, 400, 1, 4).withColumn("shard", F.col("id") % 8)
    tables.export_shards(rows, str(tmp_path / "folders"), per_file, ["shard"])
    smoke = shards.read_smoke(spark, str(tmp_path / "folders"))
    assert {r.shard for r in smoke.collect()} == {0, 1, 2} and smoke.count() == 150
    tables.export_shards(spark.range(0, 700, 1, 7), str(tmp_path / "flat"), per_file)
    assert {r.id for r in shards.read_smoke(spark, str(tmp_path / "flat")).collect()} == set(range(300))


def test_replace_table(spark):
    first = tables.replace_table(spark.range(3), "tidemark_replace")
    assert first.count() == 3
    assert tables.replace_table(spark.range(5), "tidemark_replace").count() == 5
    spark.sql("DROP TABLE tidemark_replace")


def test_profile(spark):
    rows = profile.dataset_profile({"a": spark.range(3), "b": spark.range(2)}).collect()
    assert {(r.dataset, r.n_rows, r.column_name, r.column_type) for r in rows} == {
        ("a", 3, "id", "bigint"),
        ("b", 2, "id", "bigint"),
    }


def test_scratch_follows_the_cluster_setting():
    class Cluster:
        """Stand-in for a session on a cluster; the real setting is fixed at start."""

        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = type("Context", (), {"master": "yarn", "applicationId": "a"})

    assert session.scratch_dir(Cluster("hdfs://shared/work"), "x").startswith("hdfs://shared/work/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster(None), "x")


def test_shuffle_partition_rule():
    assert session.shuffle_partitions_for(100 * 2**40, 4000) == 409_600
    assert session.shuffle_partitions_for(1, 8) == 16


WORDS = {"Fast": "typo readme", "Medium": "crash stack trace", "Slow": "redesign scheduler", "Stale": "idea someday maybe"}


def short_issues(spark, n=400):
    rows = [
        (i, f"{WORDS[label]} {i % 7}", None, "OWNER" if i % 3 else None, "2025-07-01" if i % 4 else "2025-09-01", label)
        for i in range(n)
        for label in [fixed.LABELS[(i * 7 + i // 5) % 4]]
    ]
    schema = "issue_id int, title string, body string, author_association string, issue_created_at string, label string"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("form", ["softmax", "one_vs_rest"])
def test_fit_predict_save_load(spark, tmp_path, form):
    rows = short_issues(spark)
    spec = training.LinearSpec(form=form, buckets=1024, iterations=15)
    model = training.fit_linear(splits.train_rows(rows), spec)
    test = splits.test_rows(rows)
    pairs = model.predict(test, ["issue_id"])
    assert pairs.count() == test.count() > 0
    macro = metrics.macro_f1(metrics.confusion_matrix(pairs)).first()["macro_f1"]
    assert macro > 0.9
    model.save(str(tmp_path / "m"))
    again = training.load_model(spark, str(tmp_path / "m"))
    assert again.spec == spec
    assert sorted(map(tuple, again.predict(test, ["issue_id"]).collect())) == sorted(map(tuple, pairs.collect()))


def test_selection_orders_by_macro_f1(spark):
    rows = short_issues(spark)
    specs = [training.LinearSpec(buckets=256, iterations=n) for n in (0, 5)]
    found = training.select_linear(splits.train_rows(rows), splits.test_rows(rows), specs)
    assert found[0].model.spec.iterations == 5 and found[0].macro_f1 > found[1].macro_f1
    with pytest.raises(ValueError, match="share"):
        training.select_linear(rows, rows, [specs[0], training.LinearSpec(buckets=8)])


def test_fit_refuses_unknown_labels(spark):
    rows = short_issues(spark, 40).withColumn("label", F.when(F.col("issue_id") == 3, "Odd").otherwise(F.col("label")))
    with pytest.raises(Exception, match="unknown label: Odd"):
        training.fit_linear(rows, training.LinearSpec(buckets=64, iterations=1))


def test_batch_scoring_matches_numpy(spark):
    coefficients = np.arange(12, dtype=float).reshape(3, 4) % 5
    data = np.random.default_rng(1).normal(size=(150, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "i int, x array<double>")
    got = scoring.with_prediction(df, scoring.linear_model(coefficients), "x", 3).orderBy("i").collect()
    assert np.allclose([r.scores for r in got], data @ coefficients)
    assert [r.pred_label for r in got] == [fixed.LABELS[k] for k in (data @ coefficients).argmax(1)]


def test_stream_counts_each_shard_once(spark, sf_dir, tmp_path):
    pairs = star.predictions(spark, sf_dir).repartition(5, "issue_id")
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    tables.export_shards(pairs, src)
    schema = spark.read.parquet(src).schema

    def run():
        stream = shard_scoring.shard_stream(spark, src, schema, shards_per_batch=2)
        shard_scoring.start_evaluation(stream, lambda b: b, out, state).awaitTermination()
        return {(r.true_label, r.pred_label): r.n for r in shard_scoring.evaluated_cells(spark, out).collect()}

    want = {(r.true_label, r.pred_label): r.n for r in metrics.confusion_matrix(pairs).collect()}
    assert run() == want
    assert run() == want  # nothing new, nothing counted again
    pairs.limit(10).coalesce(1).write.mode("append").parquet(src)
    assert sum(run().values()) == sum(want.values()) + 10


def test_run_folder_goes_at_the_end(spark, tmp_path):
    with session.run_folder(spark):
        path = session.scratch_dir(spark, "x")
        tables.export_shards(spark.range(3), path)
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def test_shuffles_are_sized_by_the_input(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert session.size_shuffles(spark, [str(tmp_path)]) == 16 and spark.conf.get(key) == "16"
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("codegen", ["CODEGEN_ONLY", "NO_CODEGEN"])
def test_missing_scores_are_no_label(spark, codegen):
    def load():
        return lambda x: np.where(x < 0, np.nan, x)

    df = spark.createDataFrame([(0, [1.0, 2.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0, 5.0])], "i int, x array<double>")
    got = {r.i: r.pred_label for r in scoring.with_prediction(df, load, "x", 4).collect()}
    assert got == {0: "Medium", 1: None}
    spark.conf.set("spark.sql.codegen.factoryMode", codegen)
    try:
        ids = spark.createDataFrame([(None, None), (0, []), (3, [1.0, None]), (9, [0.0, 1.0]), (-1, None)], "i int, s array<double>")
        rows = ids.select(label_name(F.col("i")).alias("a"), label_name(argmax(F.col("s"))).alias("b")).collect()
        assert [tuple(r) for r in rows] == [(None, None), ("Fast", None), ("Stale", None), (None, "Medium"), (None, None)]
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")


def test_jobs_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    rows = short_issues(spark, 160).withColumn("repo_name", F.concat(F.lit("r"), F.col("issue_id") % 5))
    tables.export_shards(rows.repartition(4, "issue_id"), f"{root}/issues")
    day = spark.range(10).select(
        F.concat(F.lit("r"), F.col("id") % 5).alias("repo_name"), F.lit("2025-06-20").cast("date").alias("date")
    )
    day = day.union(day.withColumn("date", F.lit("2025-07-01").cast("date")))
    for name, columns in {
        "pr": {"pr_merged_count": F.lit(2).cast("long"), "avg_hours_to_merge": F.lit(3.0)},
        "push": {"push_count": F.lit(1).cast("long")},
        "release": {"release_count": F.lit(1).cast("long")},
        "watch": {"star_count": F.lit(4).cast("long")},
    }.items():
        tables.export_shards(day.withColumns(columns), f"{root}/{name}")
    feeds = [word for name in ("issues", "pr", "push", "release", "watch") for word in (f"--{name}", f"{root}/{name}")]
    jobs.main(["build", *feeds, "--out", f"{root}/joined"], spark)
    built = spark.read.parquet(f"{root}/joined")
    assert built.count() == 160
    july = built.where("issue_created_at = '2025-07-01'").first()
    assert (july.pr_merged_30d, july.avg_merge_hours_30d, july.star_count_30d) == (4, 3.0, 8)

    verify = ["verify", "--issues", f"{root}/issues", "--joined", f"{root}/joined", *feeds[2:], "--repo", "r1"]
    jobs.main([*verify, "--out", f"{root}/checks"], spark)
    assert spark.read.json(f"{root}/checks/row_parity").first().asDict() == {"source_rows": 160, "joined_rows": 160}
    spots = spark.read.json(f"{root}/checks/spot_check").collect()
    assert len(spots) == 5 and all(r.stored == r.counted_again for r in spots)

    jobs.main(["profile", f"pr={root}/pr", f"joined={root}/joined", "--out", f"{root}/profile"], spark)
    assert spark.read.json(f"{root}/profile").where("dataset = 'joined'").first().n_rows == 160

    jobs.main(["train", "--input", f"{root}/joined", "--out", f"{root}/results", "--signals", "--iterations", "2"], spark)
    lines = [r.value for r in spark.read.text(f"{root}/results/lr_text_signals_eval").collect()]
    assert any(line.startswith("macro F1 ") for line in lines) and any(line.startswith("rows: train ") for line in lines)
    assert training.load_model(spark, f"{root}/results/lr_text_signals").spec.signals

    jobs.main(["score", "--input", f"{root}/joined", "--model", f"{root}/results/lr_text_signals", "--out", f"{root}/scored"], spark)
    assert spark.read.parquet(f"{root}/scored/predictions").count() == splits.test_rows(built).count()
    assert any(r.value.startswith("rows: test ") for r in spark.read.text(f"{root}/scored/report").collect())

    sampled = ["train-sampled", "--input", f"{root}/joined", "--iterations", "2", "--out", f"{root}/results"]
    jobs.main(sampled, spark)
    assert training.load_model(spark, f"{root}/results/lr_sampled").spec.l2 in (1e-4, 1e-2)

    built.limit(159).write.parquet(f"{root}/lost")
    with pytest.raises(SystemExit, match="160 issues, but 159"):
        jobs.main([*verify[:3], "--joined", f"{root}/lost", *verify[5:], "--out", f"{root}/lost_checks"], spark)
    built.withColumn("pr_merged_30d", F.col("pr_merged_30d") + 1).write.parquet(f"{root}/off")
    with pytest.raises(SystemExit, match="differ"):
        jobs.main([*verify[:3], "--joined", f"{root}/off", *verify[5:], "--out", f"{root}/off_checks"], spark)
    # Stars of the record's own day in its sum: the spot check, on merges only, sees nothing of it.
    same_day = F.when(F.to_date("issue_created_at") == "2025-07-01", F.col("star_count_30d") + 8).otherwise(F.col("star_count_30d"))
    leaky = built.withColumn("star_count_30d", same_day)
    assert leaky.exceptAll(built).count() > 0
    leaky.write.parquet(f"{root}/leaky")
    with pytest.raises(SystemExit, match="star_count_30d has days outside its window"):
        jobs.main([*verify[:3], "--joined", f"{root}/leaky", *verify[5:], "--out", f"{root}/leaky_checks"], spark)
