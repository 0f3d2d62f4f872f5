"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
#: Folders of the runs under way; the innermost holds new intermediates.
_RUN: list[str] = []

_SQL_SETTINGS = {
    # Dates are UTC days everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Hot join keys are split at run time from the real shuffle sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows with texts reach Python workers in batches of some MB, however long the texts are.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

#: For one execution: it then deletes its shuffle files when it ends, instead of when the driver collects its garbage.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time SQL settings on a session someone else created.

    Python workers find this library where driver and executors see the same folders; elsewhere
    ship it with ``--py-files``.
    """
    environment, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [environment.get("PYTHONPATH")])])
    for key, value in _SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(app: str, master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for a job. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    # Recording a Python stack per column call is a third of the time it takes to build a plan.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.getOrCreate())


def shuffle_partitions_for(input_bytes: int, cores: int) -> int:
    """Initial shuffle partition count: one per 256 MB, at least two per core. AQE merges the surplus."""
    return max(2 * cores, -(-input_bytes // TARGET_PARTITION_BYTES))


def _folder(spark: SparkSession, path: str):
    """The store's handle for ``path``, and its own form of it."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def size_shuffles(spark: SparkSession, paths: list[str]) -> int:
    """Let shuffles begin with enough partitions for the inputs; adaptive execution merges the surplus."""
    total = 0
    for path in paths:
        store, name = _folder(spark, path)
        total += store.getContentSummary(name).getLength() if store.exists(name) else 0
    wanted = shuffle_partitions_for(total, spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return wanted


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what is executed inside; those before come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing may read it any more."""
    store, name = _folder(spark, path)
    store.delete(name, True)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[None]:
    """Intermediates made inside lie in one folder, which goes when the run ends."""
    path = scratch_dir(spark, "run")
    _RUN.append(path)
    try:
        yield
    finally:
        _RUN.remove(path)
        remove(spark, path)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """New folder for a written intermediate, under the cluster's ``spark.checkpoint.dir``.

    Executors must be able to read what other executors wrote, so a machine-local
    folder is used only where there is one machine (a local master with the setting unset).
    """
    root = _RUN[-1] if _RUN else spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidemark-")
        root = _LOCAL_SCRATCH[app]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
