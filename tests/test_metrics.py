import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import metrics
from tidemark.plans import report

# Fixed values, natural order: published confusion matrices (rows true, columns predicted, label order) and macro-F1.
GOLDEN = {
    "text": (
        [[434536, 157670, 94993, 254540], [31347, 38675, 34213, 84064], [9185, 11127, 14539, 66021], [16049, 9194, 9549, 86199]],
        0.2984,
        0.425,
    ),
    "text_signals": (
        [[495868, 168207, 51707, 225957], [44941, 53573, 15919, 73866], [16603, 21139, 5876, 57254], [27716, 20298, 4768, 68209]],
        0.3005,
        0.461,
    ),
    "encoder": (
        [[501186, 232688, 69340, 138525], [40044, 76000, 33181, 39074], [16776, 37567, 22659, 23870], [25466, 24584, 12603, 58338]],
        0.3563,
        0.487,
    ),
    "encoder_signals": (
        [[532500, 188607, 95395, 125237], [45593, 62242, 43780, 36684], [18691, 28823, 29004, 24354], [30213, 19865, 15408, 55505]],
        0.3610,
        0.502,
    ),
}
# End of fixed values.


def cells(spark, matrix):
    rows = [(t, p, matrix[i][j]) for i, t in enumerate(fixed.LABELS) for j, p in enumerate(fixed.LABELS)]
    return spark.createDataFrame(rows, "true_label string, pred_label string, n bigint")


@pytest.mark.parametrize("name", GOLDEN)
def test_published_reports(spark, name):
    matrix, macro, accuracy = GOLDEN[name]
    frame = cells(spark, matrix)
    assert round(metrics.macro_f1(frame).first()["macro_f1"], 4) == macro
    lines = {r["class"]: r for r in metrics.classification_report(frame).collect()}
    assert round(lines["accuracy"].f1, 3) == accuracy
    assert lines["Fast"].support == 941739 and lines["macro avg"].support == 1351901


def test_published_averages(spark):
    lines = {r["class"]: r for r in metrics.classification_report(cells(spark, GOLDEN["text"][0])).collect()}
    shown = lambda r: tuple(round(v, 3) for v in (r.precision, r.recall, r.f1))
    assert shown(lines["Slow"]) == (0.095, 0.144, 0.114)
    assert shown(lines["macro avg"]) == (0.333, 0.381, 0.298)
    assert shown(lines["weighted avg"]) == (0.664, 0.425, 0.483)


def test_absent_class_scores_zero_and_keeps_its_cells(spark):
    pairs = spark.createDataFrame([("Fast", "Fast"), ("Fast", "Slow")], "true_label string, pred_label string")
    matrix = metrics.confusion_matrix(pairs)
    assert matrix.count() == 16
    assert matrix.agg(F.sum("n")).first()[0] == 2
    f1 = {r["class"]: r.f1 for r in metrics.class_scores(matrix).collect()}
    assert f1 == {"Fast": pytest.approx(2 / 3), "Medium": 0.0, "Slow": 0.0, "Stale": 0.0}
    ladder = metrics.model_ladder(pairs, {"m": "pred_label"}).first()
    assert ladder.macro_f1 == pytest.approx(1 / 6) and ladder.accuracy == 0.5


def test_report_text(spark):
    pairs = spark.createDataFrame([("Fast", "Fast"), ("Fast", "Slow")], "true_label string, pred_label string")
    text = report.evaluate(pairs, "Title", ["note"]).text()
    assert text.startswith("Title\nnote\n")
    assert "macro F1 0.1667, without prediction 0" in text and "across: Fast, Medium, Slow, Stale" in text


def test_rows_without_prediction_stay_in_the_support(spark):
    rows = [("Fast", "Fast"), ("Fast", None), ("Fast", "Later"), ("Slow", "Slow"), (None, "Fast"), ("Later", "Fast")]
    pairs = spark.createDataFrame(rows, "true_label string, pred_label string")
    cells = metrics.confusion_matrix(pairs, unscored=True)
    lines = {r["class"]: r for r in metrics.classification_report(cells).collect()}
    assert (lines["Fast"].support, lines["accuracy"].support, lines["accuracy"].f1) == (3, 4, 0.5)
    assert metrics.no_prediction(cells).first().unscored == 2
    ladder = metrics.model_ladder(pairs, {"m": "pred_label"}).first()
    assert (ladder.accuracy, ladder.n, ladder.unscored) == (0.5, 4, 2)
    assert "without prediction 2" in report.evaluate(pairs, "t").text()
