"""Weighted linear classifiers over issue features: fit, score, select, keep."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.functions import hashed, scalars, vectors
from tidemark.functions.scalars import label_id, label_name
from tidemark.operators import metrics, weights
from tidemark.plans import softmax
from tidemark.sources import tables


@dataclass(frozen=True)
class LinearSpec:
    """``form`` is softmax (one weighted multinomial fit) or one_vs_rest (a binary fit per label).

    ``depth`` is that of the tree that adds gradients up. One is labels x buckets doubles, 8 MB at 4 x 2^18, and the
    driver sees about tasks^(1/depth) of them at once: 3 keeps 30,000 tasks under 256 MB. ``block_mb``: rows are put
    together to blocks of at most so much memory, each of which fills a dense gradient of its own; at Spark's 1 MB
    (some 150 texts) that costs several times what the rows do.
    """

    signals: bool = False
    form: str = "softmax"
    iterations: int = 10
    l2: float = 1e-4
    buckets: int = fixed.HASH_BUCKETS
    labels: tuple[str, ...] = tuple(fixed.LABELS)
    depth: int = 3
    block_mb: float = 64.0

    def __post_init__(self) -> None:
        if self.form not in ("softmax", "one_vs_rest"):
            raise ValueError(f"unknown form: {self.form}")

    def classifier(self) -> Estimator:
        base = LogisticRegression(
            featuresCol="features",
            labelCol="label_id",
            maxIter=self.iterations,
            regParam=self.l2,
            standardization=False,
            aggregationDepth=self.depth,
            maxBlockSizeInMB=self.block_mb,
            family="multinomial" if self.form == "softmax" else "binomial",
        )
        if self.form == "softmax":
            return base.setWeightCol("weight")
        return OneVsRest(classifier=base, featuresCol="features", labelCol="label_id", weightCol="weight")

    def _parts(self) -> tuple[Column, list[Column]]:
        text = scalars.issue_text(F.col("title"), F.col("body"))
        return text, vectors.numeric_columns(F.col("author_association"), fixed.SIGNALS if self.signals else ())

    def features(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep..., features in stored form) from raw issue rows; map-only."""
        return hashed.unit_features(rows, *self._parts(), keep, self.buckets)

    def best(self, rows: DataFrame, keep: Sequence[str], sent: Broadcast) -> DataFrame:
        """(keep..., best): which of the lines in ``sent`` scores highest on the same features."""
        return hashed.unit_best(rows, *self._parts(), keep, sent, self.buckets)

    def blocks(self, rows: DataFrame) -> DataFrame:
        """The same features of rows with label_id and weight in blocks, for ``softmax``."""
        return hashed.unit_blocks(rows, *self._parts(), "label_id", "weight", self.buckets)


@dataclass(frozen=True)
class LinearModel:
    """A fitted classifier with the spec that says how its features are made."""

    spec: LinearSpec
    classifier: Model

    def predict_vectors(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        scored = self.classifier.transform(rows)
        return scored.select(*keep, label_name(F.col("prediction"), self.spec.labels).alias("pred_label"))

    def predict(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep..., true_label, pred_label) from raw issue rows; nothing is gathered."""
        named = rows.withColumn("true_label", F.col("label"))
        kept = [*keep, "true_label"]
        return self.predict_vectors(vectors.as_vectors(self.spec.features(named, kept)), kept)

    def predict_stored(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The same, written first: a re-run starts from files. Rows are scored where their terms are counted, so that
        no features are stored, which take some KB a row."""
        kept, spark = [*keep, "true_label"], rows.sparkSession
        sent = spark.sparkContext.broadcast(self._lines())
        found = self.spec.best(rows.withColumn("true_label", F.col("label")), kept, sent)
        named = found.select(*kept, label_name(F.col("best"), self.spec.labels).alias("pred_label"))
        return tables.materialize(named, session.scratch_dir(spark, "predicted"))

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights (labels x slots) and intercepts."""
        if self.spec.form == "softmax":
            return self.classifier.coefficientMatrix.toArray(), self.classifier.interceptVector.toArray()
        models = self.classifier.models
        return np.stack([m.coefficients.toArray() for m in models]), np.array([m.intercept for m in models])

    def save(self, path: str) -> None:
        """Write the classifier and the spec; replaces an earlier model."""
        self.classifier.write().overwrite().save(f"{path}/classifier")
        spark = SparkSession.active()
        spec = spark.createDataFrame([(json.dumps(asdict(self.spec)),)], "value string")
        spec.coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    stored = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    spec = LinearSpec(**{**stored, "labels": tuple(stored["labels"])})
    kind = LogisticRegressionModel if spec.form == "softmax" else OneVsRestModel
    return LinearModel(spec, kind.load(f"{path}/classifier"))


def with_training_columns(train: DataFrame, labels: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Add the label id (failing on an unknown label) and the balanced weight of the label."""
    balanced = weights.class_weights(train, labels=labels)
    checked = scalars.require_labels(train, labels=labels)
    return weights.with_class_weight(checked, balanced).withColumn(
        "label_id", label_id(F.col("label"), labels).cast("double")
    )


def feature_table(rows: DataFrame, spec: LinearSpec, keep: Sequence[str], path: str | None = None) -> DataFrame:
    """Features written once and read back as vectors.

    A fit reads its input several times and would hash the texts each time. The table also lets
    a fit go on from files when executors are lost.
    """
    spark = rows.sparkSession
    made = spec.features(rows, keep)
    path = path or session.scratch_dir(spark, "features")
    tables.export_shards(made, path, options=tables.VECTORS)
    return spark.read.schema(vectors.vector_schema(made.schema, "features")).parquet(path)


def fit_linear(train: DataFrame, spec: LinearSpec = LinearSpec(), path: str | None = None) -> LinearModel:
    """Fit on raw issue rows; ``path`` is where the blocks go (a scratch folder, deleted after the fit, if unset)."""
    spark = train.sparkSession
    own = path or session.scratch_dir(spark, "blocks")
    model = fit_ready(training_table(train, spec, own), spec)
    if path is None:
        session.remove(spark, own)
    return model


def training_table(train: DataFrame, spec: LinearSpec, path: str | None = None) -> DataFrame:
    """What a fit of ``spec`` reads, written once: blocks, the same for both forms."""
    rows = with_training_columns(train, spec.labels)
    return tables.materialize(spec.blocks(rows), path or session.scratch_dir(train.sparkSession, "blocks"), options=tables.FEW_ROWS)


def fit_ready(ready: DataFrame, spec: LinearSpec) -> LinearModel:
    """Fit on a ``training_table``."""
    numbers = len(fixed.AUTHOR_CATEGORIES) + (len(fixed.SIGNALS) if spec.signals else 0)
    classifier, size = spec.classifier(), (len(spec.labels), spec.buckets, numbers)
    if spec.form == "softmax":
        return LinearModel(spec, softmax.fit_blocks(ready, classifier, *size))
    return LinearModel(spec, _rest_model(classifier, softmax.fit_each(ready, classifier.getClassifier(), *size)))


def fit_vectors(ready: DataFrame, spec: LinearSpec) -> LinearModel:
    """Fit on a feature table with label_id and weight."""
    classifier = spec.classifier()
    return LinearModel(spec, classifier.fit(ready) if spec.form == "softmax" else _one_after_another(classifier, ready))


def _one_after_another(classifier: OneVsRest, ready: DataFrame) -> OneVsRestModel:
    """What ``classifier.fit`` gives, from the files for every label: it would keep a second copy of all vectors in the
    executors beside the blocks that each fit keeps anyway."""
    base = classifier.getClassifier()
    labels = int(ready.agg(F.max("label_id")).first()[0]) + 1
    columns = {base.labelCol: "own", base.featuresCol: "features", base.weightCol: "weight"}
    models = [
        base.fit(ready.withColumn("own", F.when(F.col("label_id") == float(i), 1.0).otherwise(0.0)), columns) for i in range(labels)
    ]
    return _rest_model(classifier, models)


def _rest_model(classifier: OneVsRest, models: list[LogisticRegressionModel]) -> OneVsRestModel:
    model = OneVsRestModel(models=models)
    for param, value in ((model.classifier, classifier.getClassifier()), (model.featuresCol, "features"), (model.labelCol, "label_id"), (model.weightCol, "weight")):
        model.set(param, value)
    return model


class MacroF1Evaluator(Evaluator):
    """Macro-F1 over the fixed labels, for use with Spark's own tuning classes as well."""

    def __init__(
        self,
        true: str = "label",
        pred: str = "pred_label",
        labels: Sequence[str] = fixed.LABELS,
    ) -> None:
        super().__init__()
        self.true, self.pred, self.labels = true, pred, list(labels)

    def _evaluate(self, dataset: DataFrame) -> float:
        cells = metrics.confusion_matrix(dataset, self.true, self.pred, self.labels, unscored=True)
        return float(metrics.macro_f1(cells).first()["macro_f1"])

    def isLargerBetter(self) -> bool:
        return True


@dataclass(frozen=True)
class Candidate:
    name: str
    macro_f1: float
    model: LinearModel


def select_linear(train: DataFrame, val: DataFrame, specs: Sequence[LinearSpec]) -> list[Candidate]:
    """Fit every spec on ``train``, score it on ``val``; best macro-F1 first.

    The features do not depend on the candidates and are made once.
    """
    first = specs[0]
    if any((s.signals, s.buckets, s.labels) != (first.signals, first.buckets, first.labels) for s in specs):
        raise ValueError("candidates must share their features")
    ready = training_table(train, first)
    check = feature_table(val, first, ["label"])
    evaluator = MacroF1Evaluator(labels=first.labels)
    found = []
    for i, spec in enumerate(specs):
        model = fit_ready(ready, spec)
        score = evaluator.evaluate(model.predict_vectors(check, ["label"]))
        found.append(Candidate(f"candidate_{i}", score, model))
    return sorted(found, key=lambda c: -c.macro_f1)


def fit_embedding_head(
    train: DataFrame,
    embedding: str,
    numeric: Sequence[str],
    labels: Sequence[str],
    iterations: int = 20,
    l2: float = 1e-4,
) -> PipelineModel:
    """Softmax head on [embedding, numeric columns] with balanced weights.

    ``train`` needs the embedding as an array column and a ``label``.
    """
    stages = [
        VectorAssembler(inputCols=["embedding_vector", *numeric], outputCol="features"),
        LogisticRegression(
            featuresCol="features",
            labelCol="label_id",
            weightCol="weight",
            family="multinomial",
            maxIter=iterations,
            regParam=l2,
            standardization=False,
        ),
        IndexToString(inputCol="prediction", outputCol="pred_label", labels=list(labels)),
    ]
    ready = with_training_columns(with_embedding_vector(train, embedding), labels)
    return Pipeline(stages=stages).fit(ready)


def with_embedding_vector(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("embedding_vector", array_to_vector(F.col(embedding)))


def predict_head(model: PipelineModel, rows: DataFrame, embedding: str, keep: Sequence[str] = ()) -> DataFrame:
    scored = model.transform(with_embedding_vector(rows, embedding))
    return scored.select(*keep, F.col("label").alias("true_label"), "pred_label")
