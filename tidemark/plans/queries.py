"""Every operator as a named query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.functions import hashed, scalars, text, vectors
from tidemark.operators import durations, metrics, quality, rollup, sampling, shuffle, splits, weights
from tidemark.operators.trailing_time import TimeMeasure, with_trailing_time
from tidemark.operators.trailing import Feed, activity_feed, signal_feeds, trailing_features, window_features
from tidemark.plans import feature_table, incremental, report, sampled, scoring, training, trees
from tidemark.sources import footers, layout, profile, shards, star, tables
from tidemark.streaming import rollup as streamed
from tidemark.streaming import shard_scoring

Query = Callable[[SparkSession, str], DataFrame]

CUTS = {"train_end": star.TRAIN_END, "test_end": star.TEST_END}


def _feeds(spark: SparkSession, sf: str) -> list[Feed]:
    return signal_feeds(*star.daily_tables(spark, sf))


def _one_read(spark: SparkSession, sf: str) -> list[Feed]:
    """The same signals with the line items read once."""
    return [activity_feed(star.activity_daily(spark, sf))]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Float sums differ in the last bits between plans."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _signals(spark: SparkSession, sf: str, dedupe_keys: bool = True, body: bool = False) -> DataFrame:
    return trailing_features(star.issues(spark, sf, body), _one_read(spark, sf), dedupe_keys=dedupe_keys)


def _stored_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Issues with signals, without texts, worked out once for all that read them."""
    return tables.materialize(_signals(spark, sf), session.scratch_dir(spark, "signals"))


def _signal_columns(df: DataFrame) -> DataFrame:
    return _rounded(df.select("issue_id", *fixed.SIGNALS), "avg_merge_hours_30d")


def _train(df: DataFrame) -> DataFrame:
    return splits.train_rows(df, train_end=star.TRAIN_END)


def _test(df: DataFrame) -> DataFrame:
    return splits.test_rows(df, **CUTS)


# Sources and sinks


def scan_issues(spark: SparkSession, sf: str) -> DataFrame:
    return star.issues(spark, sf).select(
        "issue_id",
        "repo_name",
        "author_association",
        F.col("issue_created_at").cast("string").alias("issue_created_at"),
        "label",
    )


def sample_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the first three of eight shards, each of several files."""
    path = session.scratch_dir(spark, "shards")
    shard = (F.col("issue_id") % 8).alias("shard")
    tables.export_shards(star.issues(spark, sf).select("*", shard), path, max_records=1_000, partition_by=["shard"])
    return shards.read_smoke(spark, path, ["issue_id", "label"])


def materialize_signals(spark: SparkSession, sf: str) -> DataFrame:
    path = session.scratch_dir(spark, "issues_with_signals")
    return _signal_columns(tables.materialize(_signals(spark, sf), path))


def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    daily = dict(zip(("pr_daily", "push_daily", "release_daily", "watch_daily"), star.daily_tables(spark, sf)))
    return profile.dataset_profile({"issues": star.issues(spark, sf), **daily})


def file_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and columns of stored tables from their footers, and whether row groups and bytes were found in each."""
    named = {t: f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "customer", "nation", "events")}
    found = footers.file_profile(spark, named)
    whole = (F.col("row_groups") >= F.col("files")) & (F.col("bytes") > 0)
    return found.select("dataset", "n_rows", "position", "column_name", whole.alias("has_groups"))


def laid_out_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of the test split from two stored tables, by month and bucket: issues, and the signals of each repository's
    days. Other months are not read, and no row moves for the join."""
    issues, keys = star.issues(spark, sf), ["repo_name", "issue_date"]
    known = issues.where(F.col("repo_name").isNotNull())
    days = known.select("repo_name", scalars.day_number(F.col("issue_date")).alias("_day"))
    found = window_features(days, _one_read(spark, sf), "repo_name").withColumn("issue_date", F.date_from_unix_date("_day"))
    path, stamp = session.scratch_dir(spark, "laid-out"), uuid.uuid4().hex
    narrow = issues.select("issue_id", *keys, "issue_created_at")
    stored = layout.write_laid_out(narrow, f"issues_{stamp}", "issue_date", keys, 8, f"{path}/issues")
    signals = layout.write_laid_out(found.drop("_day"), f"signals_{stamp}", "issue_date", keys, 8, f"{path}/signals")
    test, of_day = (layout.months(t, "issue_date", star.TRAIN_END, star.TEST_END) for t in (stored, signals))
    joined = test.join(of_day.drop(layout.MONTH), keys, "left")
    counts = [F.coalesce(s, F.lit(0)).alias(s) for s in fixed.SIGNALS if s != "avg_merge_hours_30d"]
    return _rounded(joined.select("issue_id", *counts, "avg_merge_hours_30d"), "avg_merge_hours_30d")


# Scalars


def issue_dates(spark: SparkSession, sf: str) -> DataFrame:
    texts = star.issues(spark, sf).select("issue_id", F.col("issue_created_at").cast("string").alias("written"))
    return texts.select(
        "issue_id",
        F.unix_seconds(scalars.instant("written")).alias("epoch_seconds"),
        scalars.utc_day("written").cast("string").alias("issue_day"),
    )


def issue_text(spark: SparkSession, sf: str) -> DataFrame:
    whole = scalars.issue_text(F.col("title"), F.col("body"))
    return star.issues(spark, sf, body=True).select(
        "issue_id", F.length(whole).cast("long").alias("n_chars"), F.md5(whole).alias("text_md5")
    )


def author_onehot(spark: SparkSession, sf: str) -> DataFrame:
    return star.issues(spark, sf).select("issue_id", *scalars.author_flags(F.col("author_association")))


def signal_log1p(spark: SparkSession, sf: str) -> DataFrame:
    logs = [F.round(scalars.signal_log(F.col(s)), 6).alias(f"log_{s}") for s in fixed.SIGNALS]
    return _signals(spark, sf).select("issue_id", *logs)


def signal_vector(spark: SparkSession, sf: str) -> DataFrame:
    vector = vectors.signal_vector(F.col("author_association"))
    filled = _signals(spark, sf).select("issue_id", vector.alias("v"))
    return filled.select("issue_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(10)])


def label_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = star.issues(spark, sf).select("issue_id", "label", scalars.label_id(F.col("label")).alias("label_id"))
    return ids.withColumn("label_back", scalars.label_name(F.col("label_id")))


# Splits, weights, samples


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    split = splits.with_split(star.issues(spark, sf), **CUTS)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Train and test rows as two filtered scans."""
    base = star.issues(spark, sf).select("issue_id", "issue_created_at")
    train = _train(base).select("issue_id", F.lit("train").alias("split"))
    return train.unionByName(_test(base).select("issue_id", F.lit("test").alias("split")))


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(weights.label_distribution(_train(star.issues(spark, sf))), "pct")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(weights.class_weights(_train(star.issues(spark, sf))), "weight")


def class_weighted_rows(spark: SparkSession, sf: str) -> DataFrame:
    train = _train(star.issues(spark, sf))
    weighted = weights.with_class_weight(train, weights.class_weights(train))
    return _rounded(weighted.select("issue_id", "label", "weight"), "weight")


def sampling_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(sampling.sampling_rates(_train(star.issues(spark, sf)), star.SAMPLE_TARGET), "rate")


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(_train(star.issues(spark, sf)), "issue_id", star.SAMPLE_TARGET)


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).select("issue_id", "label")


def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = sampled.sampled_parts(_train(star.issues(spark, sf)), "issue_id", star.SAMPLE_TARGET)
    return parts.select("issue_id", "label", "part")


def shuffled_places(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every issue in the seeded shuffle."""
    return shuffle.with_places(star.issues(spark, sf).select("issue_id"), "issue_id")


# Roll-ups of raw events


def _daily(rolled: DataFrame) -> DataFrame:
    columns = [F.col(rollup.DAY).cast("string").alias("day"), "event_type", "n", F.round("total", 6).alias("total")]
    return rollup.with_mean(rolled).select(*columns, F.round("mean", 6).alias("mean"))


def daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(rollup.daily_rollup(star.table(spark, sf, "events"), "event_type", "ts", "value"))


def daily_rollup_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up after a second batch with late events of some days: those days are counted again, no others."""
    events = star.table(spark, sf, "events")
    late = (F.col("event_id") % 7 == 0) & (F.dayofmonth("ts") % 3 == 0)
    store = rollup.DailyStore(spark, session.scratch_dir(spark, "daily"), "event_type", "ts", "value")
    store.take_in(events.where(~late), 0)
    store.take_in(events.where(late), 1)
    return _daily(store.daily(events.schema["event_type"].dataType).withColumnRenamed("entity", "event_type"))


def daily_rollup_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Closed days from two runs of one stream, and, as (late), the rows of each that came in the second run after the
    watermark had passed them. The first run sees the first half of the days, but for every 97th event."""
    events = star.table(spark, sf, "events")
    first = (F.to_date("ts") < F.lit(star.STREAM_CUT)) & (F.col("event_id") % 97 != 0)
    raw, out, state = (session.scratch_dir(spark, p) for p in ("events", "daily", "stream-state"))
    for part in (first, ~first):
        events.where(part).write.mode("append").parquet(raw)
        stream = shard_scoring.shard_stream(spark, raw, streamed.shard_schema(spark, raw))
        streamed.start_rollup(streamed.rolled_stream(stream, "event_type", "ts", "value"), out, state).awaitTermination()
    closed = rollup.stored_days(spark, out, events.schema["event_type"].dataType)
    late = streamed.late_rows(spark.read.parquet(raw), closed, "event_type", "ts", "value").where("late > 0")
    nothing = F.lit(None).cast("double")
    late = late.select(F.col("day").cast("string").alias("day"), F.lit("(late)").alias("event_type"), F.col("late").alias("n"), nothing.alias("total"), nothing.alias("mean"))
    return _daily(closed.withColumnRenamed("entity", "event_type")).unionByName(late)


def duration_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of orders by the time to their last shipment, as seen in the middle of the test split."""
    shipped = star.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("issue_id")).agg(F.max("l_shipdate").alias("closed"))
    opened = star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("issue_id"), F.col("o_orderdate").alias("opened"))
    rows = opened.join(shipped, "issue_id", "left")
    found = durations.with_duration_class(rows, "opened", "closed", star.DURATIONS, star.AS_OF)
    return _rounded(found.select("issue_id", "duration_hours", "label", "mature"), "duration_hours")


# Trailing windows


def trailing_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Of every event: the same user's events and their values in the day, and events in the hour, before it."""
    events = star.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    measures = [TimeMeasure("n_24h", 86_400), TimeMeasure("value_24h", 86_400, "sum", "value"), TimeMeasure("n_1h", 3_600)]
    found = with_trailing_time(events, events, measures, "user_id", "ts", bucket_seconds=21_600)
    return _rounded(found.select("event_id", "n_24h", "value_24h", "n_1h"), "value_24h")


def _one_feed(feed: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        chosen = _feeds(spark, sf)[feed]
        joined = trailing_features(star.issues(spark, sf), [chosen], dedupe_keys=False)
        names = [m.alias for m in chosen.measures]
        averages = [m.alias for m in chosen.measures if m.how == "avg"]
        return _rounded(joined.select("issue_id", *names), *averages)

    return run


def signals_window(spark: SparkSession, sf: str) -> DataFrame:
    """The window pass itself: one row per repository and issue day."""
    known = star.issues(spark, sf).where(F.col("repo_name").isNotNull())
    days = known.select("repo_name", scalars.day_number(F.col("issue_date")).alias("_day"))
    found = window_features(days, _one_read(spark, sf), "repo_name")
    counts = [s for s in fixed.SIGNALS if s != "avg_merge_hours_30d"]
    return _rounded(
        found.select(
            "repo_name",
            F.date_from_unix_date("_day").cast("string").alias("issue_day"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            "avg_merge_hours_30d",
        ),
        "avg_merge_hours_30d",
    )


def issues_with_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_columns(_signals(spark, sf, dedupe_keys=False))


def issues_with_signals_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_columns(_signals(spark, sf))


# Quality


def row_parity(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.materialize(_signals(spark, sf), session.scratch_dir(spark, "joined"))
    return quality.row_parity(star.issues(spark, sf), stored)


def spot_check(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.spot_check(
        _signals(spark, sf),
        star.pr_daily(spark, sf),
        star.SPOT_REPO,
        "pr_merged_30d",
        "pr_merged_count",
        fixed.SHORT_WINDOW_DAYS,
        ["issue_created_at", "issue_id"],
    )
    return found.withColumn("issue_created_at", F.col("issue_created_at").cast("string"))


def signal_zero_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table.zero_report(_signals(spark, sf))


def no_leakage(spark: SparkSession, sf: str) -> DataFrame:
    stored = tables.materialize(_signals(spark, sf), session.scratch_dir(spark, "joined"))
    return quality.leakage(stored, _feeds(spark, sf))


# Metrics


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(star.predictions(spark, sf))


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = metrics.classification_report(metrics.confusion_matrix(star.predictions(spark, sf)))
    return _rounded(lines, "precision", "recall", "f1")


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.macro_f1(metrics.confusion_matrix(star.predictions(spark, sf))), "macro_f1")


def model_ladder(spark: SparkSession, sf: str) -> DataFrame:
    author = scalars.author_category(F.col("author_association"))
    scored = star.predictions(spark, sf).withColumns(
        {
            "always_fast": F.lit("Fast"),
            "by_author": F.when(author == "OWNER", "Fast").when(author == "NONE", "Stale").otherwise("Medium"),
        }
    )
    models = {"noisy": "pred_label", "always_fast": "always_fast", "by_author": "by_author"}
    return _rounded(metrics.model_ladder(scored, models), "accuracy", "macro_f1", "weighted_f1")


def unscored_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Report and ladder where every 13th prediction is missing and every 17th is no label at all."""
    key = F.col("issue_id")
    pred = F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, F.lit("Later")).otherwise(F.col("pred_label"))
    pairs = star.predictions(spark, sf).withColumn("holed", pred)
    cells = metrics.confusion_matrix(pairs, pred="holed", unscored=True)
    lines = metrics.classification_report(cells).select("class", "recall", "f1", "support")
    missing = metrics.no_prediction(cells)
    nothing = F.lit(None).cast("double")
    lines = lines.unionByName(
        missing.select(F.lit("no prediction").alias("class"), nothing.alias("recall"), nothing.alias("f1"), F.col("unscored").alias("support"))
    )
    ladder = metrics.model_ladder(pairs, {"ladder": "holed"}).select(
        F.col("model").alias("class"), F.col("accuracy").alias("recall"), F.col("macro_f1").alias("f1"), F.col("n").alias("support")
    )
    return _rounded(lines.unionByName(ladder), "recall", "f1")


def argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores are the sums of four quarters of the embedding, whatever its width."""
    values, width = F.col("embedding").cast("array<double>"), F.size("embedding")

    def quarter(q: int) -> Column:
        first, last = F.floor(width * q / 4).cast("int"), F.floor(width * (q + 1) / 4).cast("int")
        return F.aggregate(F.slice(values, first + 1, last - first), F.lit(0.0), lambda a, x: a + x)

    best = scalars.argmax(F.array(*[quarter(q) for q in range(4)]))
    chosen = star.table(spark, sf, "embeddings").select("vec_id", best.alias("pred_id"))
    return chosen.withColumn("pred_label", scalars.label_name(F.col("pred_id")))


def stream_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix from a stream over prediction shards."""
    path, out = session.scratch_dir(spark, "shards"), session.scratch_dir(spark, "cells")
    tables.export_shards(star.predictions(spark, sf), path)
    schema = spark.read.parquet(path).schema
    stream = shard_scoring.shard_stream(spark, path, schema)
    run = shard_scoring.start_evaluation(
        stream, lambda batch: batch, out, session.scratch_dir(spark, "stream-state")
    )
    run.awaitTermination()
    return shard_scoring.evaluated_cells(spark, out)


# Text


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    counted = text.counted(text.tokens(F.col("text")), "token")
    return star.documents(spark, sf).select("doc_id", F.inline(counted))


def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = text.counted(text.terms(F.col("text")))
    return star.documents(spark, sf).select("doc_id", F.inline(counted))


def hashed_tf_md5(spark: SparkSession, sf: str) -> DataFrame:
    counted = text.hashed_counts(F.col("text"), text.bucket_md5)
    return star.documents(spark, sf).select("doc_id", F.inline(counted))


def l2_tf(spark: SparkSession, sf: str) -> DataFrame:
    scaled = text.l2_weights(text.hashed_counts(F.col("text"), text.bucket_md5))
    return _rounded(star.documents(spark, sf).select("doc_id", F.inline(scaled)), "weight")


def token_cap(spark: SparkSession, sf: str) -> DataFrame:
    words = star.documents(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("words"))
    kept = text.capped(F.col("words"))
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_tokens"),
        F.size(kept).cast("long").alias("n_kept"),
        F.md5(F.array_join(kept, " ")).alias("kept_md5"),
    )


def hashed_tf(spark: SparkSession, sf: str) -> DataFrame:
    """What the hashed vector of the models keeps of each document: its terms, and unit length."""
    rows = hashed.counted_terms(star.documents(spark, sf), F.col("text"), ["doc_id"])
    terms = F.aggregate("counted", F.lit(0).cast("long"), lambda total, b: total + b["n"])
    squares = F.aggregate("scaled", F.lit(0.0), lambda total, b: total + b["weight"] * b["weight"])
    return rows.select("doc_id", terms.alias("n_terms"), F.round(F.sqrt(squares), 6).alias("length"))


def assembled_features(spark: SparkSession, sf: str) -> DataFrame:
    """The numeric end of the assembled vector, cut out of it again, and the length of the text part."""
    rows = star.with_body(spark, sf, _stored_signals(spark, sf))
    made = training.LinearSpec(signals=True).features(rows, ["issue_id"])
    stored = F.col("features.values")
    numeric = made.select("issue_id", F.slice(stored, -10, 10).alias("v"), F.size(stored).alias("n"), stored.alias("s"))
    squares = F.aggregate(F.slice("s", F.lit(1), F.col("n") - 10), F.lit(0.0), lambda a, x: a + x * x)
    return numeric.select(
        "issue_id",
        *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(10)],
        F.round(F.sqrt(squares), 6).alias("text_length"),
    )


# Models


def _scored_text(spark: SparkSession, sf: str, spec: training.LinearSpec) -> DataFrame:
    rows = star.with_body(spark, sf, _stored_signals(spark, sf)) if spec.signals else star.issues(spark, sf, body=True)
    return training.fit_linear(_train(rows), spec).predict_stored(_test(rows), keep=["issue_id"])


#: A text model's macro-F1 must be so many times that of always naming the commonest class.
MARGIN = 1.1


def _judged(pairs: DataFrame, labels: Sequence[str] = fixed.LABELS) -> DataFrame:
    """(class, support, recounted, learnt): per class its rows, whether the report agrees with a plain recount of the
    stored predictions, and whether the model's macro-F1 is well above that of the commonest class."""
    stored = tables.materialize(pairs, session.scratch_dir(pairs.sparkSession, "pairs"))
    cells = metrics.confusion_matrix(stored, labels=labels, unscored=True)
    lines = metrics.classification_report(cells).alias("l")
    hit = F.col("true_label") == F.col("pred_label")
    again = stored.groupBy(F.col("true_label").alias("class")).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(hit) / F.count(F.lit(1))).alias("found")
    )
    total, most = F.sum("rows").over(Window.partitionBy()), F.max("rows").over(Window.partitionBy())
    share = most / total
    again = again.select("class", "rows", "found", (2 * share / (1 + share) / len(labels)).alias("constant"))
    macro = lines.where(F.col("class") == "macro avg").select(F.col("f1").alias("macro"))
    same = (F.col("support") == F.col("rows")) & (F.abs(F.col("recall") - F.col("found")) < 1e-9)
    return (
        lines.where(F.col("class").isin(*labels))
        .join(again, "class")
        .crossJoin(F.broadcast(macro))  # one row
        .select("class", "support", same.alias("recounted"), (F.col("macro") > MARGIN * F.col("constant")).alias("learnt"))
    )


def lr_text(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(_scored_text(spark, sf, training.LinearSpec()))


def lr_text_one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(_scored_text(spark, sf, training.LinearSpec(form="one_vs_rest")))


def lr_text_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(_scored_text(spark, sf, training.LinearSpec(signals=True)))


def _named(pairs: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("pred_label").isin(*fixed.LABELS), F.lit(False))
    return pairs.select("issue_id", "true_label", known.alias("named"))


def lr_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every test row, and whether it got one of the labels."""
    return _named(_scored_text(spark, sf, training.LinearSpec()))


def saved_model_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """The test split scored by a model that was saved and loaded again."""
    rows, path = star.issues(spark, sf, body=True), session.scratch_dir(spark, "model")
    training.fit_linear(_train(rows), training.LinearSpec()).save(path)
    return _named(training.load_model(spark, path).predict_stored(_test(rows), ["issue_id"]))


def sampled_training(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled run from sample to report: (item, value) for sample, holdout, class weights and test support."""
    rows = star.issues(spark, sf, body=True)
    specs = [training.LinearSpec(l2=v) for v in (1e-4, 1e-2)]
    run = sampled.train_sampled(_train(rows), _test(rows), "issue_id", specs, star.SAMPLE_TARGET)
    part = F.concat(F.lit("part "), F.col("part"))
    value = F.count(F.lit(1)).cast("double").alias("value")
    lines = run.parts.groupBy(part.alias("item")).agg(value)
    weights_ = run.weights.select(F.concat(F.lit("weight "), F.col("label")).alias("item"), F.round("weight", 6).alias("value"))
    support = metrics.class_scores(metrics.confusion_matrix(run.pairs, unscored=True))
    support = support.select(F.concat(F.lit("test "), F.col("class")).alias("item"), F.col("support").cast("double").alias("value"))
    return lines.unionByName(weights_).unionByName(support)


def fitted_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted text, text-and-signals and tree models and the commonest training class on one test split:
    (model, n, unscored, above), above: macro-F1 over that of the commonest class."""
    narrow = _stored_signals(spark, sf)
    rows = star.with_body(spark, sf, narrow)
    scored = None
    for name, signals in (("text", False), ("text_signals", True)):
        model = training.fit_linear(_train(rows), training.LinearSpec(signals=signals))
        found = model.predict_stored(_test(rows), ["issue_id"]).withColumnRenamed("pred_label", name)
        scored = found if scored is None else scored.join(found.drop("true_label"), "issue_id")
    boosted = trees.fit_trees(_train(narrow)).predict(_test(narrow), ["issue_id"]).drop("true_label")
    scored = scored.join(boosted.withColumnRenamed("pred_label", "trees"), "issue_id")
    common = weights.label_counts(_train(narrow)).orderBy(F.desc("n"), "label").first()["label"]
    stored = tables.materialize(scored.withColumn("commonest", F.lit(common)), session.scratch_dir(spark, "scored"))
    ladder = metrics.model_ladder(stored, {n: n for n in ("text", "text_signals", "trees", "commonest")})
    floor = F.max(F.when(F.col("model") == "commonest", F.col("macro_f1"))).over(Window.partitionBy())
    return ladder.select("model", "n", "unscored", (F.col("macro_f1") > floor).alias("above"))


def model_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by macro-F1 on the holdout of the stratified sample."""
    rows = _train(star.issues(spark, sf, body=True))
    parts = sampled.sampled_parts(rows, "issue_id", star.SAMPLE_TARGET)
    parts = tables.materialize(parts, session.scratch_dir(spark, "parts"))
    specs = [training.LinearSpec(l2=v) for v in (1e-4, 1e-2)]
    found = training.select_linear(
        parts.where(F.col("part") == "train"), parts.where(F.col("part") == "val"), specs
    )
    held = parts.where(F.col("part") == "val").count()
    best = max(c.macro_f1 for c in found)
    lines = [(c.name, c.model.spec.l2, held, found[0].macro_f1 == best and 0 <= c.macro_f1 <= 1) for c in found]
    return spark.createDataFrame(lines, "candidate string, l2 double, val_rows long, best_first boolean")


def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a saved and re-loaded model against those of the original: (n, differing)."""
    rows = star.issues(spark, sf, body=True)
    spec = training.LinearSpec()
    model = training.fit_linear(_train(rows), spec)
    path = session.scratch_dir(spark, "model")
    model.save(path)
    again = training.load_model(spark, path)
    test = training.feature_table(_test(rows), spec, ["issue_id"])
    before = model.predict_vectors(test, ["issue_id"])
    after = again.predict_vectors(test, ["issue_id"]).withColumnRenamed("pred_label", "reloaded")
    return before.join(after, "issue_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_label") != F.col("reloaded")).alias("differing")
    )


def tree_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on the ten numeric features. The label says whether merges take longer than they mostly do, and
    whether the author belongs to the repository: what no linear model of the vector tells apart."""
    slow, own = F.coalesce("avg_merge_hours_30d", F.lit(0.0)) > star.SLOW_MERGE, F.coalesce("author_association", F.lit("")) == "OWNER"
    label = F.when(slow & own, "Fast").when(slow, "Medium").when(own, "Slow").otherwise("Stale")
    rows = _stored_signals(spark, sf).withColumn("label", label)
    return _judged(trees.fit_trees(_train(rows)).predict(_test(rows), ["issue_id"]))


def _shards(rows: DataFrame, count: int) -> list[DataFrame]:
    """Shards by key; a fit sees one after the other."""
    return incremental.shards_of(rows, F.col("issue_id") % count, count)


def sgd_text(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of incremental fitting over eight shards, the last four by a state that was stored and loaded again."""
    rows, path = star.issues(spark, sf, body=True), session.scratch_dir(spark, "state")
    shards_ = _shards(_train(rows), 8)
    incremental.fit_shards(incremental.SgdState.new(incremental.SgdSpec()), shards_[:4], "issue_id").save(spark, path)
    state = incremental.fit_shards(incremental.SgdState.load(spark, path), shards_[4:], "issue_id")
    return _judged(incremental.predict(state, _test(rows), ["issue_id"]))


def sgd_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Two passes over four shards of the sample's training part with a check on its holdout after each: (item, value)
    for the checks and what must hold of the state that is kept."""
    rows = _train(star.issues(spark, sf, body=True))
    parts = tables.materialize(sampled.sampled_parts(rows, "issue_id", star.SAMPLE_TARGET), session.scratch_dir(spark, "parts"))
    val, patience = parts.where("part = 'val'"), 3
    fit = incremental.fit_with_checkpoints(
        spark, incremental.SgdState.new(incremental.SgdSpec()), _shards(parts.where("part = 'train'"), 4), val, "issue_id",
        session.scratch_dir(spark, "checkpoints"), patience=patience, passes=2,
    )
    kept = tables.materialize(incremental.predict(fit.model(spark), val, ["issue_id"]), session.scratch_dir(spark, "kept"))
    again = metrics.macro_f1(metrics.confusion_matrix(kept, unscored=True)).first()["macro_f1"]
    scores = [c.macro_f1 for c in fit.history]
    best = scores.index(max(scores))
    lines = [
        ("holdout rows", float(kept.count())),
        ("kept is the first best", float(fit.best == fit.history[best])),
        ("kept scores as when stored", float(abs(again - fit.best.macro_f1) < 1e-9)),
        ("ended in time", float(len(scores) == min(8, best + 1 + patience))),
        ("said why it ended", float(fit.stopped == (len(scores) < 8))),
    ]
    return spark.createDataFrame(lines, "item string, value double")


def embedding_signals_lr(spark: SparkSession, sf: str) -> DataFrame:
    """Head on [embedding, 10 numeric features], a tenth of the vectors held out by hash. The label is that of
    ``argmax_label``, which the embedding holds; the table's own labels can't be told from it."""
    flags = scalars.author_flags(F.col("author_association"))
    logs = [scalars.signal_log(F.col(s)).alias(f"log_{s}") for s in fixed.SIGNALS]
    issues = _signals(spark, sf).select("issue_id", *flags, *logs)
    numeric = issues.columns[1:]
    embeddings = star.table(spark, sf, "embeddings").drop("label")
    embeddings = embeddings.join(argmax_label(spark, sf).select("vec_id", F.col("pred_label").alias("label")), "vec_id")
    rows = embeddings.join(issues, F.col("vec_id") == F.col("issue_id"), "left").fillna(0, numeric)
    rows = tables.materialize(rows, session.scratch_dir(spark, "embedding_rows"))
    held_out = scalars.bucket_fraction(F.col("vec_id")) < 0.1
    model = training.fit_embedding_head(rows.where(~held_out), "embedding", numeric, fixed.LABELS)
    scored = training.predict_head(model, rows.where(held_out), "embedding")
    return _judged(scored)


def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Whole embedding table through a fixed 64 x 4 linear scorer."""
    row, column = np.indices((64, 4))
    coefficients = ((row + 1) * (column + 1) % 7 - 3).astype(np.float64)
    scored = scoring.with_prediction(
        star.table(spark, sf, "embeddings").select("vec_id", "embedding"),
        scoring.linear_model(coefficients),
        "embedding",
        width=64,
    )
    scores = [F.round(F.col("scores")[i], 5).alias(f"score_{i}") for i in range(4)]
    return scored.select("vec_id", *scores, "pred_label")


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """The printed report, written to a folder and read back line by line."""
    path = session.scratch_dir(spark, "report")
    made = report.evaluate(star.predictions(spark, sf), "Stand-in predictions", report.header({"test": None}, CUTS))
    report.write_report(spark, made, path)
    return spark.read.text(path)


QUERIES: dict[str, Query] = {
    "scan_issues": scan_issues,
    "sample_shards": sample_shards,
    "materialize_signals": materialize_signals,
    "dataset_profile": dataset_profile,
    "eval_report": eval_report,
    "issue_dates": issue_dates,
    "issue_text": issue_text,
    "author_onehot": author_onehot,
    "signal_log1p": signal_log1p,
    "signal_vector": signal_vector,
    "label_ids": label_ids,
    "temporal_split": temporal_split,
    "split_rows": split_rows,
    "label_distribution": label_distribution,
    "class_weights": class_weights,
    "class_weighted_rows": class_weighted_rows,
    "sampling_rates": sampling_rates,
    "stratified_sample": stratified_sample,
    "train_val_split": train_val_split,
    "shuffled_places": shuffled_places,
    "file_profile": file_profile,
    "laid_out_signals": laid_out_signals,
    "duration_classes": duration_classes,
    "daily_rollup": daily_rollup,
    "daily_rollup_corrected": daily_rollup_corrected,
    "daily_rollup_stream": daily_rollup_stream,
    "trailing_hours": trailing_hours,
    "signal_pr": _one_feed(0),
    "signal_push": _one_feed(1),
    "signal_release": _one_feed(2),
    "signal_watch": _one_feed(3),
    "signals_window": signals_window,
    "issues_with_signals": issues_with_signals,
    "issues_with_signals_dedup": issues_with_signals_dedup,
    "row_parity": row_parity,
    "spot_check": spot_check,
    "signal_zero_fraction": signal_zero_fraction,
    "no_leakage": no_leakage,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "macro_f1": macro_f1,
    "model_ladder": model_ladder,
    "unscored_evaluation": unscored_evaluation,
    "argmax_label": argmax_label,
    "stream_evaluation": stream_evaluation,
    "tokens": tokens,
    "ngram_counts": ngram_counts,
    "hashed_tf_md5": hashed_tf_md5,
    "l2_tf": l2_tf,
    "token_cap": token_cap,
    "hashed_tf": hashed_tf,
    "assembled_features": assembled_features,
    "lr_text": lr_text,
    "lr_text_one_vs_rest": lr_text_one_vs_rest,
    "lr_text_signals": lr_text_signals,
    "lr_predictions": lr_predictions,
    "saved_model_scoring": saved_model_scoring,
    "fitted_ladder": fitted_ladder,
    "sampled_training": sampled_training,
    "model_selection": model_selection,
    "model_roundtrip": model_roundtrip,
    "tree_signals": tree_signals,
    "sgd_text": sgd_text,
    "sgd_checkpoints": sgd_checkpoints,
    "embedding_signals_lr": embedding_signals_lr,
    "batch_scoring": batch_scoring,
}


def prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return query(session.prepare(spark), sf)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run
