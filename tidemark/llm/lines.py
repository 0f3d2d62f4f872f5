"""Removal of lines that many distinct sites share, found with a HyperLogLog sketch of sites per line hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.files import shielded

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: Sketches have 2^LOG_BUCKETS buckets; three standard errors of their estimate are SKETCH_ERROR of it.
LOG_BUCKETS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (LOG_BUCKETS / 2)

_BLANK = " \t\r\x0b\x0c"


def _key(column: str = "text") -> list[Column]:
    return [F.col("doc_id").alias("_id"), F.xxhash64(column).alias("_of")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(_id, _of, _site, _no, _line): every line that is not blank, by its hash. Blanks at its ends don't count.

    A null source is a site of its own, the same as an empty one. ``_of`` tells texts apart that share a doc_id.
    """
    site = F.coalesce(F.col("source"), F.lit("")).alias("_site")
    rows = docs.select(*_key(), site, F.posexplode(F.split("text", "\n", -1)).alias("_no", "_raw"))
    trimmed = F.btrim("_raw", F.lit(_BLANK))
    return rows.where(trimmed != "").select("_id", "_of", "_site", "_no", F.xxhash64(trimmed).alias("_line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(_line, _first): hashes of lines on at least ``min_sites`` distinct sites, and their first place.

    Sketches of sites are merged by aggregation. Where the estimate is within its error of the threshold, the
    distinct sites are counted exactly; elsewhere the sketch decides. The first place is the smallest (doc_id, line).
    """
    rows = lines_of(docs)
    first = F.min(F.struct("_id", "_no")).alias("_first")
    sketches = rows.groupBy("_line").agg(F.hll_sketch_agg("_site", LOG_BUCKETS).alias("_sites"), first)
    spread = sketches.select("_line", "_first", F.hll_sketch_estimate("_sites").alias("_n"))
    margin = max(1.0, min_sites * SKETCH_ERROR)
    spread = spread.where(F.col("_n") >= min_sites - margin)
    sure = spread.where(F.col("_n") > min_sites + margin).select("_line", "_first")
    near = spread.where(F.col("_n") <= min_sites + margin).select("_line", "_first")
    counted = (
        rows.select("_line", "_site").join(near.select("_line"), "_line", "left_semi").distinct().groupBy("_line").count()
    )
    return sure.union(near.join(counted.where(F.col("count") >= min_sites).select("_line"), "_line"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``lines_total`` and ``lines_removed``.

    ``docs`` has ``doc_id``, ``text`` and ``source`` (the site); other columns stay. With ``keep_first`` a line stays
    in its first place, so that nothing leaves the corpus altogether. Every row stays: a null text stays null with 0
    lines, an empty one is one blank line, and a text of which all lines go becomes empty. Blank lines are never
    boilerplate. Rows that repeat a doc_id and text are treated alike; a null doc_id is an id like others.
    """
    found = boilerplate(docs, min_sites)
    hits = lines_of(docs).select("_id", "_of", "_no", "_line").join(found, "_line")
    if keep_first:
        place = F.struct("_id", "_no")
        hits = hits.where(~place.eqNullSafe(F.col("_first")))
    gone = hits.groupBy("_id", "_of").agg(F.collect_set("_no").alias("_gone"))
    rows, names = shielded(docs)
    text = F.col(names["text"])
    rows = rows.withColumns({"_lid": F.col(names["doc_id"]), "_lof": F.xxhash64(text)})
    same = F.col("_lid").eqNullSafe(F.col("_id")) & (F.col("_lof") == F.col("_of"))
    rows = rows.join(gone, same, "left")
    lines = F.split(text, "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.transform(F.filter(numbered, lambda p: ~F.array_contains("_gone", p["i"])), lambda p: p["x"])
    removed = F.coalesce(F.size("_gone"), F.lit(0))
    changed = {"text": F.when(removed > 0, F.array_join(kept, "\n")).otherwise(text)}
    total = F.when(text.isNull(), 0).otherwise(F.size(lines))
    columns = [changed.get(c, F.col(n)) for c, n in names.items()]
    return rows.select(*columns, total, removed).toDF(*docs.columns, "lines_total", "lines_removed")
