"""Blocks of features: what they hold, how large they are on disk and in a task, and the fits over them."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.functions import hashed
from tidemark.plans import softmax, training
from tidemark.sources import tables

WORDS = ["typo", "readme", "crash", "stack", "trace", "redesign", "scheduler", "größe", "über", "alles", "number", "the", "of"]


def _issues(spark, count, words=12):
    texts = [" ".join(WORDS[(i * 7 + k * k + i // 13) % len(WORDS)] for k in range(words)) for i in range(count)]
    rows = [(i, t, f"{t} w{i % 11}" if i % 5 else None, "OWNER" if i % 3 else None, fixed.LABELS[(i * 7 + i // 9) % 4]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "issue_id int, title string, body string, author_association string, label string")


def _texts(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{v}" for v in rng.zipf(1.3, 300) % 20_000) for _ in range(600)]
    rows = [(i, t, None, "OWNER", fixed.LABELS[i % 4]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "issue_id int, title string, body string, author_association string, label string").coalesce(1)


def _folders(root, purpose):
    return [f for f in os.listdir(root) if f.startswith(purpose)]


@pytest.fixture
def scratch(tmp_path, monkeypatch):
    """Intermediates lie in this folder."""
    monkeypatch.setattr(session, "_RUN", [str(tmp_path)])
    return str(tmp_path)


def test_whole_numbers_survive_packing():
    for values in ([], [0], [0, 0, 255, 256], [1, 2**31, 2**32 - 1], [5, 2**40, 2**33], list(range(70_000))):
        values = np.array(values, np.uint64)
        assert hashed._unpacked(pa.py_buffer(hashed._packed(values))).tolist() == values.tolist()


def test_blocks_hold_the_features_in_two_bytes_an_entry(spark, scratch):
    rows, spec = _texts(spark), training.LinearSpec()
    found = training.training_table(rows, spec, f"{scratch}/blocks").toArrow().to_batches()
    blocks = [b for batch in found for b in hashed.opened(batch)]
    want = spec.features(rows, ["issue_id"]).orderBy("issue_id").collect()
    got = [{} for _ in blocks[0].label]
    for b in blocks:
        slot = np.repeat(b.slots, b.sizes)
        for s, r, n in zip(slot.tolist(), b.row.tolist(), b.n.tolist()):
            got[r][s] = n / b.length[r]
    assert len(blocks) == 1 and len(got) == 600
    for own, row in zip(got, want):
        count = len(row.features.indices) - len(fixed.AUTHOR_CATEGORIES)
        assert own == pytest.approx(dict(zip(row.features.indices[:count], row.features["values"][:count])), abs=1e-12)
    size = sum(os.path.getsize(f"{scratch}/blocks/{f}") for f in os.listdir(f"{scratch}/blocks") if f.endswith(".parquet"))
    assert size < 2 * sum(len(b.row) for b in blocks)


def test_large_rows_are_written_in_row_groups_of_few(spark, scratch):
    """A hundred rows at least would be held at once by writer, reader and worker, whatever their size."""
    rows = spark.range(0, 40, 1, 1).select(F.col("id"), F.expr("repeat(md5(cast(id as string)), 30000)").cast("binary").alias("block"))
    stored = tables.materialize(rows, f"{scratch}/large", options={**tables.FEW_ROWS, "compression": "none"})
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 12
    assert stored.where("length(block) = 960000").count() == 40


def test_blocks_of_a_fit_are_written_that_way(spark, scratch, monkeypatch):
    seen = []
    real = tables.export_shards
    monkeypatch.setattr(tables, "export_shards", lambda *a, options=None, **k: (seen.append(options), real(*a, options=options, **k)))
    training.training_table(_issues(spark, 20), training.LinearSpec(buckets=64))
    assert seen == [tables.FEW_ROWS]


def test_a_pass_sends_a_sum_per_core_and_turn_and_not_per_file(spark, scratch):
    """And workers get a block or two at once."""
    blocks = training.training_table(_issues(spark, 400).repartition(60), training.LinearSpec(buckets=256), f"{scratch}/blocks")
    with session.settings(spark, {"spark.sql.files.openCostInBytes": str(256 << 20)}):
        assert blocks.rdd.getNumPartitions() >= 60
        most = softmax.TURNS * spark.sparkContext.defaultParallelism

        def add(block, total):
            total[0] += len(block.label)
            total[1] = 1  # once a task

        rows, tasks = softmax.summed(blocks, 16, add)[:2]
    assert rows == 400 and 1 <= tasks <= most < 60
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


@pytest.mark.parametrize("every", [True, False])
def test_fits_per_label_over_blocks_are_those_of_spark(spark, scratch, every):
    # No constants: their deviation is a rounding error to Spark, which then finds no step.
    rows = _issues(spark, 200).withColumns({s: (F.col("issue_id") * (k + 3) % (11 + k)).cast("double") for k, s in enumerate(fixed.SIGNALS)})
    rows = (rows if every else rows.where("label != 'Medium'")).coalesce(2)
    spec = training.LinearSpec(signals=True, form="one_vs_rest", buckets=512, l2=1e-2, iterations=5)
    model = training.fit_linear(rows, spec)
    vectors = training.feature_table(training.with_training_columns(rows), spec, ["label_id", "weight"])
    expected = spec.classifier().fit(vectors)
    assert len(model.classifier.models) == len(expected.models) == 4
    for own, other in zip(model.classifier.models, expected.models, strict=True):
        np.testing.assert_allclose(own.coefficients.toArray(), other.coefficients.toArray(), atol=1e-6)
        np.testing.assert_allclose(own.intercept, other.intercept, atol=1e-6)
    model.save(f"{scratch}/model")
    again = training.load_model(spark, f"{scratch}/model")
    want = {r.issue_id: r.pred_label for r in training.LinearModel(spec, expected).predict(rows, ["issue_id"]).collect()}
    assert {r.issue_id: r.pred_label for r in again.predict_stored(rows, ["issue_id"]).collect()} == want


def test_a_fit_leaves_no_blocks_and_scoring_stores_no_features(spark, scratch):
    rows = _issues(spark, 200).repartition(2)
    model = training.fit_linear(rows, training.LinearSpec(buckets=256, iterations=2))
    assert not _folders(scratch, "blocks") and not _folders(scratch, "features")
    found = model.predict_stored(rows, ["issue_id"])
    assert not _folders(scratch, "features") and len(_folders(scratch, "predicted")) == 1
    key = lambda r: r.issue_id
    assert sorted(found.collect(), key=key) == sorted(model.predict(rows, ["issue_id"]).collect(), key=key)


def test_feature_tables_are_small(spark, scratch):
    rows, spec = _texts(spark), training.LinearSpec()
    table = training.feature_table(rows, spec, ["issue_id"], f"{scratch}/features")
    spec.features(rows, ["issue_id"]).write.parquet(f"{scratch}/plain")
    own, plain = (sum(os.path.getsize(f"{scratch}/{d}/{f}") for f in os.listdir(f"{scratch}/{d}")) for d in ("features", "plain"))
    assert own < 0.9 * plain  # 0.4 on large tables
    want = {r.issue_id: r.features for r in spec.features(rows, ["issue_id"]).collect()}
    for r in table.collect():
        assert r.features.indices.tolist() == want[r.issue_id].indices and r.features.values.tolist() == want[r.issue_id]["values"]
