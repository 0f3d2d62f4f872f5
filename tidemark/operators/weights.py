"""Label counts and balanced class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n). Partial counts run before the shuffle, so a dominant label costs nothing."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, pct). The un-partitioned window sees one row per label."""
    total = F.sum("n").over(Window.partitionBy())
    return label_counts(df, label).withColumn("pct", 100 * F.col("n") / total)


def class_weights(df: DataFrame, label: str = "label", labels: Sequence[str] = fixed.LABELS) -> DataFrame:
    """(label, n, weight), weight = rows / (classes * rows of the class)."""
    total = F.sum("n").over(Window.partitionBy())
    counts = label_counts(df.where(F.col(label).isin(*labels)), label)
    return counts.withColumn("weight", total.cast("double") / (F.lit(len(labels)) * F.col("n")))


def with_class_weight(rows: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the weight of their label; the job fails and names the label that has none.

    ``weights`` comes from ``class_weights`` and so has at most one row per known label.
    """
    found = rows.join(F.broadcast(weights.select(label, F.col("weight").alias("_weight"))), label, "left")
    missing = F.raise_error(F.concat(F.lit("no weight for label: "), F.coalesce(F.col(label), F.lit("NULL"))))
    weight = F.when(F.col("_weight").isNotNull(), F.col("_weight")).otherwise(missing.cast("double"))
    return found.withColumn("weight", weight).drop("_weight")
