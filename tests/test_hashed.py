import numpy as np
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import hashed, scalars, text, vectors
from tidemark.plans import training
from tidemark.sources import star

ODD = [
    "", "a", "ab", "a b", "Ab  cd—ef ǅž İstanbul ΣΑΣ ΣΣ", "日本語 テスト x 漢 字字 𝔘𝔫𝔦 𝔘 ٣٤ ½½ a_b __ _ é éé ß ẞẞ", "x" * 70_000 + " yy",
    "naïve café ÀÉ\nnew\tline a1 1a 11 1", "ab", " ", "İ", "ΑΣ ΑΣΣ. ΑΣ'", "Ⅷ Ⅷⅷ ②② ᾼᾼ ǈǈ", "a\x00b ab\x00cd", None, "end é", "é", "éa", "aé",
]


def _odd(spark):
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "i long, text string")
    return rows.coalesce(1)


def test_terms_counted_in_batches_are_those_of_the_expressions(spark):
    rows = _odd(spark)
    for buckets in (2**18, 64, 1000):
        counted = text.hashed_counts(F.col("text"), lambda t: text.bucket_murmur(t, buckets))  # noqa: B023
        expected = rows.select("i", counted.alias("counted"), text.l2_weights(counted).alias("scaled")).orderBy("i").collect()
        assert hashed.counted_terms(rows, F.col("text"), ["i"], buckets).orderBy("i").collect() == expected


def test_features_of_a_spec_are_those_of_the_expression(spark):
    """Including a number that is missing: the logarithm of what lies below -1."""
    rows = _odd(spark).select(
        "i", F.col("text").alias("title"), F.when(F.col("i") % 2 == 0, "more words").alias("body"), F.lit("owner").alias("author_association"),
        *[F.lit(v).alias(s) for s, v in zip(training.fixed.SIGNALS, (3, -2.0, 0, None, 7), strict=True)],
    )
    for signals in (False, True):
        whole = scalars.issue_text(F.col("title"), F.col("body"))
        made = vectors.issue_features(whole, F.col("author_association"), training.fixed.SIGNALS if signals else ())
        own = training.LinearSpec(signals=signals).features(rows, ["i"])
        assert own.orderBy("i").collect() == rows.select("i", made.alias("features")).orderBy("i").collect()


def test_features_evaluate_no_lambda_for_every_term(spark):
    rows = _odd(spark).select("i", F.col("text").alias("title"), F.lit(None).cast("string").alias("body"), F.lit("x").alias("author_association"))
    plan = training.LinearSpec().features(rows, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_pieces_of_a_batch_do_not_change_its_rows(spark):
    import pyarrow as pa

    texts = pa.array(["ab cd"] * 5 + ["", None, "x y zz zz"] + ["long words here " * 50])
    whole = [(low, high) for low, high, _, _ in hashed._pieces(texts)]
    assert whole == [(0, 9)]
    hashed._PIECE, before = 12, hashed._PIECE
    try:
        parts = list(hashed._pieces(texts.slice(1)))
        assert parts[0][0] == 0 and parts[-1][1] == 8 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert b"".join(d.tobytes() for _, _, d, _ in parts).decode() == "".join(t or "" for t in texts.slice(1).to_pylist())
    finally:
        hashed._PIECE = before


def test_one_vs_rest_keeps_no_second_copy_of_the_vectors(spark, monkeypatch, tmp_path):
    rows = spark.range(80).selectExpr(
        "id as issue_id", "element_at(array('Fast', 'Medium', 'Slow', 'Stale'), cast(id % 4 as int) + 1) as label",
        "concat('word', id % 4, ' other') as title", "cast(null as string) as body", "'OWNER' as author_association",
    )
    spec = training.LinearSpec(form="one_vs_rest", buckets=64)
    ready = training.feature_table(training.with_training_columns(rows), spec, ["label_id", "weight"])
    expected = spec.classifier().fit(ready)

    def refused(*_, **__):
        raise AssertionError("vectors were persisted")

    with monkeypatch.context() as patched:
        patched.setattr(type(ready), "persist", refused)
        model = training.fit_vectors(ready, spec)
    for own, other in zip(model.classifier.models, expected.models, strict=True):
        assert abs(own.coefficients.toArray() - other.coefficients.toArray()).max() < 1e-6
    model.save(f"{tmp_path}/model")
    found = training.load_model(spark, f"{tmp_path}/model").predict_stored(rows, ["issue_id"])
    assert found.where("true_label = pred_label").count() == 80


def test_blocks_of_a_fit_are_larger_than_their_gradient(spark):
    base = training.LinearSpec().classifier()
    assert base.getMaxBlockSizeInMB() * 2**20 > 4 * training.fixed.HASH_BUCKETS * 8


def test_texts_of_issues_are_spread_over_the_cores(spark, sf_dir):
    assert star.issues(spark, sf_dir, body=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_softmax_over_blocks_takes_the_steps_of_spark(spark):
    texts = ["typo in the readme", "the crash has a stack trace, a trace", "redesign of the scheduler", "", "größe über alles"]
    rows = [(i, texts[(i * 7) % 5], f"{texts[i % 5]} number {i % 13}", "OWNER" if i % 3 else None, float(i % 11), fixed.LABELS[(i * 7) % 5 % 4]) for i in range(300)]
    schema = "issue_id int, title string, body string, author_association string, star_count_30d double, label string"
    frame = spark.createDataFrame(rows, schema).withColumns({s: F.lit(1.5) for s in fixed.SIGNALS if s != "star_count_30d"}).repartition(3)
    spec = training.LinearSpec(signals=True, buckets=512, l2=1e-3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # several batches are one block
    table = training.training_table(frame, spec)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert table.count() == 3
    model = training.fit_ready(table, spec).classifier
    expected = spec.classifier().fit(training.feature_table(training.with_training_columns(frame), spec, ["label_id", "weight"]))
    np.testing.assert_allclose(model.coefficientMatrix.toArray(), expected.coefficientMatrix.toArray(), atol=1e-6)
    np.testing.assert_allclose(model.interceptVector.toArray(), expected.interceptVector.toArray(), atol=1e-6)
    one = training.fit_linear(frame.where("label = 'Medium'"), spec)
    assert {r.pred_label for r in one.predict(frame).collect()} == {"Medium"}
