"""The sampled-training run: sample, holdout, weights, candidates, full test split, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.operators import sampling, splits, weights
from tidemark.plans import training
from tidemark.sources import tables


@dataclass(frozen=True)
class SampledRun:
    """``parts`` has the sample with ``part`` (train, val), ``pairs`` the whole test split scored by the best."""

    parts: DataFrame
    weights: DataFrame
    candidates: list[training.Candidate]
    pairs: DataFrame

    @property
    def best(self) -> training.Candidate:
        return self.candidates[0]

    def counts(self) -> dict[str, int]:
        """Rows trained on, validated on and tested on, for a report's heading."""
        found = {r.part: r.n for r in self.parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"train": found.get("train", 0), "validation": found.get("val", 0), "test": self.pairs.count()}


def sampled_parts(train: DataFrame, key: str, target: int = fixed.SAMPLE_TARGET) -> DataFrame:
    """The stratified sample with its holdout. It is written once, and derived once from the train table."""
    sample = sampling.stratified_sample(train, key, target)
    stored = tables.materialize(sample, session.scratch_dir(train.sparkSession, "sample"))
    return splits.with_holdout(stored, key)


def train_sampled(
    train: DataFrame,
    test: DataFrame,
    key: str,
    specs: Sequence[training.LinearSpec],
    target: int = fixed.SAMPLE_TARGET,
) -> SampledRun:
    """Fit the candidates on the sample without its holdout, keep the best on the holdout, score all test rows.

    ``key`` is a unique row id (see ``shards.with_row_id``).
    """
    spark = train.sparkSession
    parts = tables.materialize(sampled_parts(train, key, target), session.scratch_dir(spark, "parts"))
    fitted = parts.where(F.col("part") == "train")
    candidates = training.select_linear(fitted, parts.where(F.col("part") == "val"), specs)
    pairs = candidates[0].model.predict_stored(test, [key])
    stored = tables.materialize(pairs, session.scratch_dir(spark, "pairs"))
    return SampledRun(parts, weights.class_weights(fitted), candidates, stored)
