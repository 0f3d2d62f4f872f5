"""A tree model on the ten numeric features alone: weighted one-vs-rest boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.functions.scalars import label_name
from tidemark.functions.vectors import signal_vector
from tidemark.plans.training import with_training_columns
from tidemark.sources import tables

#: Slots of the vector.
FEATURES = [f"log_{s}" for s in fixed.SIGNALS] + [f"is_{c.lower()}" for c in fixed.AUTHOR_CATEGORIES]


@dataclass(frozen=True)
class TreeSpec:
    """``rounds`` trees of ``depth`` per label; each sees a share of the rows, drawn by a fixed seed."""

    rounds: int = 10
    depth: int = 4
    step: float = 0.3
    share: float = 0.8
    bins: int = 64
    labels: tuple[str, ...] = tuple(fixed.LABELS)

    def classifier(self) -> OneVsRest:
        trees = GBTClassifier(
            featuresCol="features", labelCol="label_id", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step,
            subsamplingRate=self.share, maxBins=self.bins, seed=fixed.SEED,
        )
        return OneVsRest(classifier=trees, featuresCol="features", labelCol="label_id", weightCol="weight")


@dataclass(frozen=True)
class TreeModel:
    spec: TreeSpec
    classifier: OneVsRestModel

    def predict(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep..., true_label, pred_label) of rows with the signals and the author."""
        kept = [*keep, "true_label"]
        ready = _vectors(rows.withColumn("true_label", F.col("label")), kept)
        found = self.classifier.transform(ready)
        return found.select(*kept, label_name(F.col("prediction"), self.spec.labels).alias("pred_label"))

    def importances(self) -> list[tuple[str, float]]:
        """Features by their share in what the trees of all labels gain, the largest first."""
        mean = np.mean([m.featureImportances.toArray() for m in self.classifier.models], axis=0)
        return sorted(zip(FEATURES, mean.tolist(), strict=True), key=lambda p: -p[1])


def _vectors(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return rows.select(*keep, array_to_vector(signal_vector(F.col("author_association"))).alias("features"))


def fit_trees(train: DataFrame, spec: TreeSpec = TreeSpec()) -> TreeModel:
    """Fit on rows with a label, the five signals and author_association; labels weigh inversely to their rows.

    The narrow vectors are written first: every tree reads them, and a fit goes on from files if executors are lost.
    """
    ready = _vectors(with_training_columns(train, spec.labels), ["label_id", "weight"])
    ready = tables.materialize(ready, session.scratch_dir(train.sparkSession, "tree-features"))
    return TreeModel(spec, spec.classifier().fit(ready))
