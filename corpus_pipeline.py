"""From raw documents to packed training sequences: five stages, each one operator of ``tidemark.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, lines, mixing, packing
from tidemark.llm.files import drop, settled, shielded
from tidemark.llm.keys import row_key
from tidemark.llm.queries import prepared

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter, empty and null ones included, are rejected and go.

    If no document has a label there is no language to predict, and texts are judged by their letters alone."""
    prepared(spark)
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(language.LETTER))
    named, names = shielded(language.predict(docs, model, docs.columns).toDF(*docs.columns, "_lang_pred", "_score"))
    kept = named.where(F.col(names["_lang_pred"]) != language.UNDETERMINED)
    return kept.select(*(names[c] for c in docs.columns)).toDF(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more sources share (each stays in its first place); documents of which
    nothing is left go. ``n_chars`` follows the text."""
    prepared(spark)
    rows, names = shielded(docs)
    back = {names[c]: c for c in ("doc_id", "text", "source")}
    cleaned = lines.without_boilerplate(rows.withColumnsRenamed(back))
    text, removed = F.col("text"), F.col("lines_removed") > 0
    kept = cleaned.where(text.isNull() | ~removed | text.rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for own, name in names.items():
        column = F.col(own if name in back else name)
        columns.append(F.when(removed, F.char_length("text")).otherwise(column).alias(own) if own == "n_chars" else column.alias(own))
    return kept.select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose sets of 5-word shingles are 80 % alike.

    Rows that repeat an id and text are one. Documents without words are in no group and stay.
    """
    prepared(spark)
    row = row_key(docs, [F.col("doc_id"), F.col("text")])
    groups = settled(jaccard.join_components(docs.select(row.alias("doc_id"), "text")).select("doc_id", "component_id").distinct(), "groups")
    ids = docs.select(F.col("doc_id").alias("own"), row.alias("doc_id"))
    first = F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("first")
    kept = ids.join(groups, "doc_id").groupBy("component_id").agg(first).select(F.col("first.doc_id").alias("_row"))
    kept = settled(kept, "kept")
    rows, names = shielded(docs)
    keyed = rows.withColumn("_row", row_key(rows, [F.col(names["doc_id"]), F.col(names["text"])]))
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*names.values()).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix of sources takes them."""
    prepared(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4,096 tokens."""
    prepared(spark)
    return packing.packed(packing.cut(docs, end=1))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", one_of_each_group),
    ("source_mix", mixed),
    ("packing", packed),
]

#: Fits and tokenizers have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table, each written and read again."""
    docs, before = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
