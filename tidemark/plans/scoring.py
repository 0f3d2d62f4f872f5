"""Batched scoring with a model loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed
from tidemark.functions.scalars import argmax, label_name

Model = Callable[[np.ndarray], np.ndarray]


def batch_scores(load: Callable[[], Model], features: Column, width: int, batch: int = fixed.SCORING_BATCH) -> Column:
    """Array of scores per row. ``load`` runs once per worker and returns a function from a
    (batch, width) array to a (batch, classes) array; rows reach it in Arrow batches."""
    score = predict_batch_udf(
        load,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch,
        input_tensor_shapes=[[width]],
    )
    return score(features)


def with_prediction(
    rows: DataFrame,
    load: Callable[[], Model],
    features: str,
    width: int,
    labels=fixed.LABELS,
    batch: int = fixed.SCORING_BATCH,
) -> DataFrame:
    """Rows with ``scores`` and the label of the highest one as ``pred_label``."""
    scored = rows.withColumn("scores", batch_scores(load, F.col(features), width, batch))
    return scored.withColumn("pred_label", label_name(argmax(F.col("scores")), labels))


def linear_model(coefficients: np.ndarray) -> Callable[[], Model]:
    """Loader for a linear scorer with a (width, classes) matrix."""

    def load() -> Model:
        return lambda x: np.asarray(x, dtype=np.float64) @ coefficients

    return load
