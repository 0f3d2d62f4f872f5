"""Issue-like views over the star-schema test tables (nation = repository, order = issue,
line items shipped on a day = that day's activity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_END = "2000-01-01"
TEST_END = "2001-01-01"
#: Rows that the test queries sample; the production target is ``fixed.SAMPLE_TARGET``.
SAMPLE_TARGET = 3_000
SPOT_REPO = "NATION_7"
#: Hours that end the classes of orders by time to shipment, and the instant they are judged at.
DURATIONS, AS_OF = (24.0 * 365, 24.0 * 730, 24.0 * 1095), "2000-07-01"
#: Mean merge hours beyond which merges are slow: the middle of the quantities that stand in for hours.
SLOW_MERGE = 25.5
#: Where the first run of the streamed roll-up ends.
STREAM_CUT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    """Issues; ``body`` adds the document text, which most queries do not need."""
    orders = table(spark, sf_dir, "orders")
    orders = _spread(orders) if body else orders
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key, priority, segment = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("c_mktsegment")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    columns = [
        key.alias("issue_id"),
        F.col("n_name").alias("repo_name"),
        F.when(key % 17 != 0, priority).alias("title"),
        F.when(segment == "AUTOMOBILE", "COLLABORATOR")
        .when(segment == "BUILDING", "contributor")
        .when(segment == "FURNITURE", "FIRST_TIMER")
        .when(segment == "HOUSEHOLD", F.lit(None))
        .otherwise("OWNER")
        .alias("author_association"),
        F.col("o_orderdate").alias("issue_created_at"),
        F.to_date("o_orderdate").alias("issue_date"),
        F.when(priority == "1-URGENT", "Fast")
        .when(priority == "2-HIGH", "Medium")
        .when(priority == "3-MEDIUM", "Slow")
        .otherwise("Stale")
        .alias("label"),
    ]
    found = base.select(*columns)
    return _with_body(spark, sf_dir, found) if body else found


def _spread(rows: DataFrame) -> DataFrame:
    """Texts are found and used in as many tasks as there are cores, however few files hold the narrow rows."""
    wanted = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def with_body(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Stored rows of ``issues`` with the document text."""
    return _with_body(spark, sf_dir, _spread(rows))


def _with_body(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    documents, key = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("issue_id")
    n_documents = documents.agg(F.count(F.lit(1))).scalar()
    joined = rows.withColumn("_doc", key % n_documents).join(documents, F.col("_doc") == F.col("doc_id"), "left")
    return joined.select(*rows.columns, F.when(key % 5 != 0, F.col("text")).alias("body"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .select(
            F.col("n_name").alias("repo_name"),
            F.to_date("l_shipdate").alias("date"),
            "l_quantity",
            "l_returnflag",
            "l_linestatus",
            "l_linenumber",
        )
    )


def _pr(active: DataFrame) -> DataFrame:
    return (
        active.where(F.col("l_returnflag") == "R")
        .groupBy("repo_name", "date")
        .agg(F.count(F.lit(1)).alias("pr_merged_count"), F.avg("l_quantity").alias("avg_hours_to_merge"))
    )


def _push(active: DataFrame) -> DataFrame:
    pushed = active.where(F.col("l_linestatus") == "F")
    return pushed.groupBy("repo_name", "date").agg(F.count(F.lit(1)).alias("push_count"))


def _release(active: DataFrame) -> DataFrame:
    released = active.where(F.col("l_linenumber") == 7)
    return released.groupBy("repo_name", "date").agg(F.count(F.lit(1)).alias("release_count"))


def _watch(active: DataFrame) -> DataFrame:
    return active.groupBy("repo_name", "date").agg(F.sum("l_quantity").cast("long").alias("star_count"))


def daily_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The pr, push, release and watch tables."""
    active = activity(spark, sf_dir)
    return [_pr(active), _push(active), _release(active), _watch(active)]


def activity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of all four daily tables in one row per (repository, day), from one read."""
    merged = F.col("l_returnflag") == "R"
    return (
        activity(spark, sf_dir)
        .groupBy("repo_name", "date")
        .agg(
            F.count_if(merged).alias("pr_merged_count"),
            F.avg(F.when(merged, F.col("l_quantity"))).alias("avg_hours_to_merge"),
            F.count_if(F.col("l_linestatus") == "F").alias("push_count"),
            F.count_if(F.col("l_linenumber") == 7).alias("release_count"),
            F.sum("l_quantity").cast("long").alias("star_count"),
        )
    )


def pr_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pr(activity(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in predictions on the test split, so that metrics can be checked without a model."""
    from tidemark.operators.splits import test_rows

    test = test_rows(issues(spark, sf_dir), train_end=TRAIN_END, test_end=TEST_END)
    key = F.col("issue_id")
    guess = (
        F.when(key % 4 == 0, "Fast").when(key % 4 == 1, "Medium").when(key % 4 == 2, "Slow").otherwise("Stale")
    )
    return test.select(
        "issue_id",
        F.col("label").alias("true_label"),
        F.when(key % 10 < 6, F.col("label")).otherwise(guess).alias("pred_label"),
        "author_association",
    )
