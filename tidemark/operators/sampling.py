"""Reproducible stratified sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.scalars import bucket_fraction
from tidemark.operators.weights import label_counts


def sampling_rates(
    train: DataFrame,
    target: int = fixed.SAMPLE_TARGET,
    label: str = "label",
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """(label, n, rate): each label's share of ``target`` over its count, at most 1.

    Labels outside ``labels`` count in the total but get no rate.
    """
    total = F.sum("n").over(Window.partitionBy())
    share = F.lit(target).cast("double") * F.col("n") / total
    rates = label_counts(train, label).withColumn("rate", F.least(F.lit(1.0), share / F.col("n")))
    return rates.where(F.col(label).isin(*labels))


def stratified_sample(
    train: DataFrame,
    key: str,
    target: int = fixed.SAMPLE_TARGET,
    seed: int = fixed.SEED,
    label: str = "label",
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Bernoulli sample of each label at its rate, decided by the md5 of seed and ``key``.

    ``key`` must be unique (``sources.shards.with_row_id`` makes one where there is none), then
    copies of a row are drawn independently. One narrow counting pass, then a map-only filter:
    the rates are one row per known label.
    """
    rates = sampling_rates(train, target, label, labels).select(label, "rate")
    drawn = train.join(F.broadcast(rates), label).where(bucket_fraction(F.col(key), seed) < F.col("rate"))
    return drawn.select(*train.columns)
