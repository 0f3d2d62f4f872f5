"""The queries of this package: each applies one operator, with production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, forest, idfile, jaccard, kneser, language, lines, manifest, mixing, neighbours, packing, periodic, substrings
from tidemark.llm.files import settled
from tidemark.llm.keys import digest
from tidemark.session import prepare


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with the settings that these operators rely on."""
    prepare(spark)
    # Texts may be long: fewer rows travel to a Python worker at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled documents that are not held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(5) == 0)
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model, ["doc_id", "held_out"])


def op2_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token-id files and read back."""
    return idfile.read(idfile.write(read(spark, sf_dir, "documents"), end=2))


def op3_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are 85 % alike."""
    return jaccard.join_components(read(spark, sf_dir, "documents"), k=4, percent=85)


def op4_window_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 35 words repeat, and what is left."""
    cut = substrings.without_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, less those that ten or more sources share (all but their first place)."""
    cleaned = lines.without_boilerplate(read(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("lines_total").cast("long").alias("n_lines"),
        F.col("lines_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a model of the documents that are not held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder(7) == 2)
    return kneser.scored(docs, kneser.fit(docs.where("not held_out"), order=kneser.ORDER), ["doc_id", "held_out"])


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the balanced mix takes of every document."""
    docs = read(spark, sf_dir, "documents")
    key = digest([F.col("doc_id"), F.col("text"), F.col("source")])
    docs = settled(docs.select("doc_id", "source", key.alias("key"), mixing.word_count().alias("size")), "sizes")
    plan = mixing.copies(docs, "key", "size").drop("source", "size")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return docs.join(plan, "key").select("doc_id", "size", "source_size", "target", taken, "source", "rate", "copies")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return fingerprints.compared(read(spark, sf_dir, "documents"))


def minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles are 80 % alike, by bands of their fingerprints."""
    return fingerprints.near_duplicates(read(spark, sf_dir, "documents"))


def op9_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth one."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 4,096 tokens."""
    return packing.packed(packing.cut(read(spark, sf_dir, "documents"), end=1))


def op11_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether it still leads to the root after tampering."""
    docs = read(spark, sf_dir, "documents")
    text, values = F.col("text"), ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(remainder(2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    now = manifest.leaf([*map(F.col, values), tampered])
    made = manifest.build(docs, [*values, "text"], group="source", order="doc_id", keep={"doc_id": F.col("doc_id"), "now": now})
    return manifest.checked(made, "now", ["doc_id"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat, of every document (a tenth with a planted one), and the text without the repeats."""
    docs = read(spark, sf_dir, "documents")
    found = periodic.find(docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
    # The greatest length, then the smallest start, then the smallest period.
    most = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    start, length, period = -most.start, most.length, -most.period
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, with those of its label that have a cosine of 0.93 or more."""
    return forest.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_id_blocks": op2_id_blocks,
    "op3_token_groups": op3_token_groups,
    "op4_window_repeats": op4_window_repeats,
    "op5_line_spread": op5_line_spread,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_entropy_mix": op7_entropy_mix,
    "op8_minhash": op8_minhash,
    "minhash_components": minhash_components,
    "op9_multiprobe": op9_multiprobe,
    "op10_patterns": op10_patterns,
    "op11_interval_manifest": op11_interval_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_projection_forest": op13_projection_forest,
}
