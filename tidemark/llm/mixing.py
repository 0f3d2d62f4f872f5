"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to their prior rates as the token constraints of all sources allow, in the sense of
relative entropy per token. The dual is convex with one multiplier per source: a rate is the prior rate tilted by the
exponential of its source's multiplier, and at most ``cap``. Newton iterations over sums that Spark makes find the
multipliers. Rates then become whole copies, errors being carried on from long documents to short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.files import settled, shielded
from tidemark.llm.keys import digest

#: Source weights in code point order of the names, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Copies of a document, and so the most a source can grow.
CAP = 3
#: Documents rounded in one task, about.
PART = 20_000

_FREE = 700.0  # a multiplier that lifts every positive rate to the cap


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size; one row each) with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target stops at
    ``cap`` times its source's size, and the excess is shared again by weight until none is above.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)  # one row per source
    table = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    table = settled(table, "weights")
    full = cap * F.col("source_size")
    level, before = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_w") * level >= full
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, full)).alias("fixed"),
            F.sum(F.when(~above, F.col("_w"))).alias("w"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if not row.w or row.n == before:
            break
        before, level = row.n, (share * (row.total or 0) - (row.fixed or 0)) / row.w
    target = full if level is None else F.least(full, F.col("_w") * F.lit(level))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def multipliers(masses: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """(source, target, _lam): the dual's solution.

    ``masses`` has (source, prior, mass): tokens by source and prior rate. Each round sums tokens and slopes under
    the present multipliers and takes a Newton step on the logarithm of each constraint, halving the interval known to
    hold the solution instead where the step would leave it.
    """
    state = goals.select("source", "target", F.lit(0.0).alias("_lam"), F.lit(-_FREE).alias("_lo"), F.lit(_FREE).alias("_hi"))
    masses = settled(masses, "masses")
    for _ in range(rounds):
        state = settled(state, "multipliers")
        s, m = state.alias("s"), masses.withColumnRenamed("source", "_of").alias("m")
        rate = F.col("prior") * F.exp("_lam")
        sums = (
            s.join(m, F.col("source").eqNullSafe(F.col("_of")), "left")
            .groupBy("source", "target", "_lam", "_lo", "_hi")
            .agg(
                F.coalesce(F.sum(F.col("mass") * F.least(F.lit(float(cap)), rate)), F.lit(0.0)).alias("_f"),
                F.coalesce(F.sum(F.when(rate < cap, F.col("mass") * rate)), F.lit(0.0)).alias("_g"),
            )
        )
        sums = settled(sums, "sums")
        off = F.abs(F.col("_f") - F.col("target")) > tolerance * F.greatest(F.col("target"), F.lit(1.0))
        wide = F.col("_hi") - F.col("_lo") > 1e-12
        if sums.where(off & wide).isEmpty():
            break
        low = F.col("_f") < F.col("target")
        lo, hi = F.when(low, F.col("_lam")).otherwise(F.col("_lo")), F.when(low, F.col("_hi")).otherwise(F.col("_lam"))
        step = F.col("_lam") + (F.log("target") - F.log("_f")) * F.col("_f") / F.col("_g")
        fine = step.isNotNull() & (step > lo) & (step < hi)
        lam = F.when(off & wide, F.when(fine, step).otherwise((lo + hi) / 2)).otherwise(F.col("_lam"))
        state = sums.select("source", "target", lam.alias("_lam"), lo.alias("_lo"), hi.alias("_hi"))
    return state.select("source", "target", "_lam")


def rounded(size: np.ndarray, rate: np.ndarray, times: np.ndarray, cap: int) -> np.ndarray:
    """Copies of each document, longest first; what a document gets too much or too little goes on to the next ones."""
    out, carry = np.zeros(len(size), dtype=np.int64), 0.0
    for i, (n, r, m) in enumerate(zip(size.tolist(), rate.tolist(), times.tolist(), strict=True)):
        if n == 0:
            out[i] = min(cap, round(r))
            continue
        want = r * n * m + carry
        out[i] = min(cap, max(0, round(want / (n * m))))
        carry = want - int(out[i]) * n * m
    return out


def copies(docs: DataFrame, key: str, size: str, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, prior: Column | None = None) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies) for every different (key, source, size) of ``docs``.

    ``docs`` has ``source``, ``key`` (equal for equal rows) and ``size`` (tokens, not null); ``prior`` is the rate before
    balancing, 1 unless given. Equal rows get equal copies. Rates are rounded within parts of a source's documents,
    drawn by key, in an order that depends on the rows alone, so that reruns agree and a large source is many tasks.
    """
    prior = F.lit(1.0) if prior is None else prior.cast("double")
    rows = docs.select("source", F.col(key).alias("_doc"), F.col(size).cast("long").alias("_words"), prior.alias("_prior"))
    rows = settled(rows.groupBy("source", "_doc", "_words", "_prior").agg(F.count(F.lit(1)).alias("_times")), "sizes")
    mass = F.col("_words") * F.col("_times")
    masses = rows.groupBy("source", F.col("_prior").alias("prior")).agg(F.sum(mass).alias("mass"))
    sources = rows.groupBy("source").agg(F.sum(mass).alias("source_size"), F.ceil(F.count(F.lit(1)) / PART).alias("_parts"))
    goals = settled(targets(sources.drop("_parts"), weights, cap=cap), "targets")
    solved = multipliers(masses, goals, cap)
    known = goals.select(F.col("source").alias("_s"), "source_size").join(
        sources.select(F.col("source").alias("_s2"), "_parts"), F.col("_s").eqNullSafe(F.col("_s2"))
    )
    known = known.join(solved, F.col("_s").eqNullSafe(F.col("source"))).select("_s", "source_size", "_parts", "target", "_lam")
    known = settled(known, "solved")
    rate = F.least(F.lit(float(cap)), F.col("_prior") * F.exp("_lam"))
    part = F.pmod(F.xxhash64("_doc", "_words"), F.col("_parts"))
    table = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "_doc", "_words", "_times", "source_size", "target", rate.alias("rate"), part.alias("_part")
    )
    schema = table.drop("_part", "_times").schema

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_words", "descending"), ("_doc", "ascending")])
        n = rounded(*(group.column(c).to_numpy() for c in ("_words", "rate", "_times")), cap)
        return group.drop_columns(["_part", "_times"]).append_column("copies", pa.array(n))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = table.groupBy("source", "_part").applyInArrow(whole, f"{names}, copies long")
    return out.withColumnsRenamed({"_doc": key, "_words": size})


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix: rows of ``docs`` (doc_id, text, source, ...), each as often as it has copies, with the same columns.

    Sizes are words; texts that are null or without words count nothing and get the copies nearest to their source's
    rate. An empty table gives an empty one, as does one without any word.
    """
    rows, names = shielded(docs)
    doc_id, text, source = (F.col(names[c]) for c in ("doc_id", "text", "source"))
    keyed = rows.withColumns({"_key": digest([doc_id, text, source]), "_size": word_count(names["text"])})
    plan = copies(keyed.select(source.alias("source"), "_key", "_size"), "_key", "_size", weights, cap)
    plan = plan.where("copies > 0").select("_key", "copies")
    repeated = keyed.join(plan, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*names.values()).toDF(*docs.columns)
