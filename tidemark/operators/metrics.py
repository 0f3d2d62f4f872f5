"""Evaluation from (true, predicted) pairs. Pairs are counted where they lie; after that every
frame has at most one row per cell of the confusion matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed


def confusion_matrix(
    pairs: DataFrame,
    true: str = "true_label",
    pred: str = "pred_label",
    labels: Sequence[str] = fixed.LABELS,
    unscored: bool = False,
) -> DataFrame:
    """(true_label, pred_label, n), zero cells kept. Rows whose true label is not in ``labels`` are left out.

    So are rows whose prediction is not, unless ``unscored``: then they count under a NULL prediction, and the
    scores made from the cells hold them in the support of their class.
    """
    known = F.when(F.col(pred).isin(*labels), F.col(pred))
    rows = pairs.select(F.col(true).alias("true_label"), known.alias("pred_label"))
    rows = rows.where(F.col("true_label").isin(*labels))
    if not unscored:
        rows = rows.where(F.col("pred_label").isNotNull())
    counts = rows.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(v) for v in labels])
    grid = (
        pairs.sparkSession.range(1)
        .select(F.explode(names).alias("true_label"))
        .select("true_label", F.explode(names).alias("pred_label"), F.lit(0).cast("long").alias("n"))
    )
    return counts.unionByName(grid).groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def class_scores(cells: DataFrame) -> DataFrame:
    """Per class: tp, support, predicted, precision, recall, f1 (0 where undefined)."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("true_label").alias("class"),
            hit.cast("long").alias("tp"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col("pred_label").alias("class"),
            zero.alias("tp"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    totals = (
        cells.select(F.inline(sides))
        .where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return totals.select(
        "class",
        "tp",
        "support",
        "predicted",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"),
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support): one row per class, then the lines
    accuracy (in the f1 column, as printed reports have it), macro avg and weighted avg."""
    scores = class_scores(cells)
    n = F.sum("support")
    names = ("precision", "recall", "f1")
    macro = [F.avg(c).alias(f"macro_{c}") for c in names]
    weighted = [_ratio(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{c}") for c in names]
    summary = scores.agg(*macro, *weighted, _ratio(F.sum("tp"), n).alias("accuracy"), n.alias("support"))
    nothing = F.lit(None).cast("double")

    def line(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("support").alias("support"),
        )

    lines = F.array(
        line("accuracy", nothing, nothing, F.col("accuracy")),
        line("macro avg", *[F.col(f"macro_{c}") for c in names]),
        line("weighted avg", *[F.col(f"weighted_{c}") for c in names]),
    )
    per_class = scores.select("class", *names, "support")
    return per_class.unionByName(summary.select(F.inline(lines)))


def no_prediction(cells: DataFrame) -> DataFrame:
    """One row, ``unscored``: rows without a usable prediction, from cells made with ``unscored``."""
    missing = F.sum(F.when(F.col("pred_label").isNull(), F.col("n")))
    return cells.agg(F.coalesce(missing, F.lit(0)).alias("unscored"))


def macro_f1(cells: DataFrame) -> DataFrame:
    """One row, ``macro_f1``: the plain mean of the per-class F1."""
    return class_scores(cells).agg(F.avg("f1").alias("macro_f1"))


def model_ladder(
    scored: DataFrame,
    models: Mapping[str, str],
    true: str = "true_label",
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Compare models on the same rows: (model, accuracy, macro_f1, weighted_f1, n, unscored).

    A prediction that is NULL or not in ``labels`` is a miss, and is counted in ``unscored``.

    ``models`` maps a model name to its prediction column. The rows are read once for all
    models and leave each map task as counts.
    """
    by_model = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred_label")) for m, c in models.items()]
    )
    tall = scored.select(F.col(true).alias("true_label"), F.inline(by_model))
    known = F.when(F.col("pred_label").isin(*labels), F.col("pred_label"))
    tall = tall.where(F.col("true_label").isin(*labels)).withColumn("pred_label", known)
    counts = tall.groupBy("model", "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    missed = F.sum(F.when(F.col("pred_label").isNull(), F.col("n")).otherwise(0))
    tp = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0))
    of_true = counts.groupBy("model", F.col("true_label").alias("class")).agg(
        tp.alias("tp"), F.sum("n").alias("support"), F.lit(0).cast("long").alias("predicted"), missed.alias("missed")
    )
    of_pred = counts.where(F.col("pred_label").isNotNull()).groupBy("model", F.col("pred_label").alias("class")).agg(
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("support"),
        F.sum("n").alias("predicted"),
        F.lit(0).cast("long").alias("missed"),
    )
    classes = (
        of_true.unionByName(of_pred)
        .groupBy("model", "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted", "missed")])
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    )
    n = F.sum("support")
    return classes.groupBy("model").agg(
        _ratio(F.sum("tp"), n).alias("accuracy"),
        (F.sum("f1") / len(labels)).alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        n.alias("n"),
        F.sum("missed").alias("unscored"),
    )
