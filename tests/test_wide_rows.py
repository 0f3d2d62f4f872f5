"""Where rows with texts go: not through the signals' joins, and not into stores that stay."""

import os

import pytest
from test_stored_signals import Stop, tables  # noqa: F401

from tidemark import fixed, session
from tidemark.plans import incremental, queries


def test_signals_are_joined_before_texts(spark, tables, monkeypatch):  # noqa: F811
    """Before, every text was shuffled once more, to get its five numbers."""
    read = []

    def stop(train, spec=None):
        read.extend(train.inputFiles())
        raise Stop

    monkeypatch.setattr(queries.training, "fit_linear", stop)
    with pytest.raises(Stop):
        queries.lr_text_signals(spark, tables)
    made = queries.assembled_features(spark, tables)
    for files in (read, made.inputFiles()):
        assert any("documents" in f for f in files) and any("/signals-" in f for f in files)
        assert not any("lineitem" in f for f in files)
    assert made.count() == 60


def test_features_of_one_shard_are_stored_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_RUN", [str(tmp_path)])
    rows = spark.createDataFrame([(i, "a word", f"number w{i % 7}", "OWNER", fixed.LABELS[i % 4]) for i in range(60)], "issue_id int, title string, body string, author_association string, label string")
    seen, real = [], incremental.fit_round

    def counted(state, ready):
        seen.append(len(os.listdir(tmp_path)))
        return real(state, ready)

    monkeypatch.setattr(incremental, "fit_round", counted)
    state = incremental.SgdState.new(incremental.SgdSpec(buckets=64))
    state = incremental.fit_shards(state, incremental.shards_of(rows, rows.issue_id % 3, 3), "issue_id")
    assert seen == [1, 1, 1] and not os.listdir(tmp_path) and sum(state.seen) == 60
