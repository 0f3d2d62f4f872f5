import re
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text, vectors


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_tokens(spark):
    got = frame(spark, "Étion I a re_1 x86 don't Über").select(text.tokens(F.col("text"))).first()[0]
    assert got == ["étion", "re_1", "x86", "don", "über"]


def test_empty_text_gives_nothing(spark):
    row = frame(spark, "").select(
        text.terms(F.col("text")), text.hashed_counts(F.col("text")), text.l2_weights(text.hashed_counts(F.col("text")))
    ).first()
    assert [len(v) for v in row] == [0, 0, 0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB é_1 .\n", max_size=40), min_size=1, max_size=5))
def test_counts_match_a_plain_count(spark, texts):
    got = frame(spark, *texts).select("i", text.counted(text.terms(F.col("text"))).alias("c")).collect()
    for row in got:
        words = re.findall(r"\b\w\w+\b", texts[row.i].lower())
        want = Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:]))
        assert {e.term: e.n for e in row.c} == dict(want)


def test_unit_length_features(spark):
    df = frame(spark, "red red blue", "").select(
        "i", vectors.issue_features(F.col("text"), F.lit("owner"), (), 64).alias("features")
    )
    rows = {r.i: r.features for r in vectors.as_vectors(df).collect()}
    full, empty = rows[0], rows[1]
    assert full.size == 69 and empty.size == 69
    assert list(full.toArray()[64:]) == [0, 0, 0, 0, 1]
    assert np.isclose(np.linalg.norm(full.toArray()[:64]), 1)
    assert not empty.toArray()[:64].any()
    assert list(full.indices) == sorted(set(full.indices))


def test_array_form_agrees_with_ml_stages(spark):
    """Both hash alike up to the names of the buckets: the same weights in some order."""
    texts = ["alpha beta alpha gamma", "one two three two one"]
    df = frame(spark, *texts)
    ml = PipelineModel(stages=vectors.text_stages(2**18)).transform(df).select("i", "text_vector").collect()
    own = df.select("i", text.l2_weights(text.hashed_counts(F.col("text"))).alias("w")).collect()
    by_id = {r.i: sorted(e.weight for e in r.w) for r in own}
    for row in ml:
        assert np.allclose(sorted(row.text_vector.values), by_id[row.i])


def test_text_work_does_not_shuffle(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = documents.select("doc_id", F.inline(text.hashed_counts(F.col("text"))))._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()


def test_cap_reads_the_whole_text(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    row = frame(spark, long).select(text.tokens(F.col("text")).alias("w")).select(
        F.size("w"), F.size(text.capped(F.col("w")))
    ).first()
    assert tuple(row) == (1000, fixed.MAX_TOKENS)
