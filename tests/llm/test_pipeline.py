from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import check_packing
from tidemark.llm import mixing
from tidemark.llm.files import settled


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean documents, exact and near copies, a line on many sites, and texts without letters."""
    drawn = np.random.default_rng(11)
    vocabulary = ["".join(drawn.choice(list("abcdefghijklmnop"), drawn.integers(2, 9))) for _ in range(900)]
    rows, banner = [], "we use cookies to make this site better for you"
    for i in range(60):
        text = " ".join(drawn.choice(vocabulary, int(drawn.integers(30, 120))))
        rows.append((i, text + ("\n" + banner if i % 3 == 0 else ""), "en", f"s{i % 14}"))
    for i in range(60, 75):
        words = rows[i - 60][1].split(" ")
        if i % 2:
            words[5] = "changed"
        rows.append((i, " ".join(words), "en", f"s{i % 14}"))
    rows += [(80, None, "en", "s1"), (81, "", None, "s1"), (82, "12 34", None, None), (None, None, None, None)]
    return spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_stages_against_brute_force(spark, corpus, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "source_mix", "packing"]
    docs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs[name] = corpus = settled(stage(spark, corpus, sf_dir), name)
        if name != "packing":
            assert corpus.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert {r.doc_id for r in docs["language_id"].collect()} == set(range(75))

    cleaned = {r.doc_id: r.text for r in docs["line_dedup"].collect()}
    assert sum("cookies" in t for t in cleaned.values()) == 1 and "cookies" in cleaned[0] and len(cleaned) == 75

    groups = brute.components({i: brute.shingles(t, 5) for i, t in cleaned.items()}, 80)
    kept = {r.doc_id for r in docs["near_duplicates"].collect()}
    assert kept == set(groups.values()) and docs["near_duplicates"].count() == len(kept) < 75

    before, after = docs["near_duplicates"], docs["source_mix"]
    sizes = {r.source: r.n for r in before.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    taken = {r.source: r.n for r in after.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    for r in mixing.targets(frame).collect():
        assert abs(taken.get(r.source, 0) - r.target) < 60
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    check_packing(docs["packing"].collect(), [(r.doc_id, r.text) for r in after.collect()])


def test_odd_rows_go_through_every_stage(spark, odd, nothing, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == odd.columns
        assert stage(spark, nothing, sf_dir).isEmpty()


def test_documents_without_labels_stay(spark, corpus, sf_dir):
    kept = corpus_pipeline.known_language(spark, corpus.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert kept.columns == corpus.columns and sorted(r.doc_id for r in kept.collect()) == list(range(75))


def test_repeated_rows_are_one_document(spark, odd, sf_dir):
    kept = corpus_pipeline.one_of_each_group(spark, odd, sf_dir).collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 3, 4, 5, 6, 7, 9, 10, 12, None])


def test_run_over_the_documents(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(rows) > 100 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
