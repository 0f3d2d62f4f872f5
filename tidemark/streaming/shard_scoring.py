"""Evaluation over a growing folder of shards with bounded memory.

A structured stream takes the shards that came since its last run, scores them and writes their confusion
counts, at most one row per cell. A batch that runs again after a failure replaces its own
output, so each shard counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark import fixed
from tidemark.operators.metrics import confusion_matrix

Scorer = Callable[[DataFrame], DataFrame]

_CELLS = T.StructType(
    [
        T.StructField("true_label", T.StringType()),
        T.StructField("pred_label", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def shard_stream(spark: SparkSession, path: str, schema: T.StructType, shards_per_batch: int | None = None) -> DataFrame:
    """Shards of a folder as a stream, each delivered once, in arrival order.

    A batch takes all shards that are there, and so the whole cluster, unless ``shards_per_batch`` bounds it.
    """
    reader = spark.readStream.schema(schema)
    if shards_per_batch:
        reader = reader.option("maxFilesPerTrigger", shards_per_batch)
    return reader.parquet(path)


def start_evaluation(
    shards: DataFrame,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    labels: Sequence[str] = fixed.LABELS,
) -> StreamingQuery:
    """Score every shard now present and stop. ``scorer`` adds true_label and pred_label.

    Start it again with the same checkpoint to take in the shards that came since.
    """

    def count_batch(batch: DataFrame, batch_id: int) -> None:
        cells = confusion_matrix(scorer(batch), labels=labels)
        cells.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        shards.writeStream.foreachBatch(count_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def evaluated_cells(spark: SparkSession, out: str) -> DataFrame:
    """The confusion matrix over all batches so far."""
    batches = spark.read.schema(_CELLS).parquet(f"{out}/batch=*")
    return batches.groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"))
