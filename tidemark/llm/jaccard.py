"""Exact Jaccard self-join of documents' word n-grams over a token-group matrix.

Documents with equal sets are one. The others are partitioned into groups of similar ones (by the token of their prefix
that most sets have). Links inside a group are found in one task. Between groups, a matrix of tokens and groups gives for a document
the groups it may have a partner in; a group is opened for it only if its overlap with the group's token union, which
bounds that with every member, and the sizes allow the similarity asked for. Links join components; what is already
one component isn't compared again, so that no group of copies is expanded into pairs, and no component is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.files import drop, settled

#: Members of a group, about; larger groups are split. A set counts as one member for each so many tokens begun.
GROUP, TOKENS = 1024, 4096
#: Counters of the sketch of shingle frequencies, a power of two, and in how many rows they are sent.
COUNTERS, PARTS = 1 << 20, 16
#: Bits by which rows of ids that are not wanted are left out (4 MB, sent to the executors).
BITS = 1 << 25

_IDS = "_id long, _n int, _least int, _sig binary, _prefix array<long>"
_LINKS = "a long, b long"


class Rule:
    """Similar: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be over 0 and at most 100")
        self.percent = percent

    def slack(self, n: int) -> int:
        """Tokens of a set of ``n`` that a similar set may lack."""
        return n - -(-self.percent * n // 100)

    def need(self, n: int) -> int:
        """Tokens that similar sets of at least ``n`` tokens share in their prefixes: one, or a third of the slack."""
        return max(1, self.slack(n) // 3)

    def prefix(self, n: int) -> int:
        """The first so many tokens, in any common order, hold the first ``need`` tokens shared with a similar set."""
        return self.slack(n) + self.need(n) if n else 0

    def least(self, n: int) -> int:
        """Tokens that a set of ``n`` shares with the prefix of any similar set, the smallest possible included."""
        return self.need(-(-self.percent * n // 100))

    def linked(self, common: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (n + m - common)

    def sizes(self, a: Column, low: Column, high: Column) -> Column:
        """Some size from ``low`` to ``high`` can be similar to size ``a``."""
        return (100 * high >= self.percent * a) & (self.percent * low <= 100 * a)


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """Level of each of the sketch's counters: 0 for usual shingles, one more for each doubling above.

    All documents are counted into a sketch of fixed size. A counter's usual count grows with the input, its spread
    with the root of that; what is over both belongs to a frequent shingle. The levels only order tokens (frequent
    ones last), so that shared counters cost time and never a link.
    """
    width = COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in words.pieces(batches, "text", 1 << 22):
            hashed, bounds = words.hashed(batch.column("text"), lower=True)
            runs = words.rolled(hashed, k)
            total += np.bincount(runs >> np.uint64(44), minlength=COUNTERS).astype(np.uint32)
        parts = [total[i * width : (i + 1) * width].tobytes() for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint64)
        for counts in table.column("counts").to_pylist():
            total += np.frombuffer(counts, dtype=np.uint32)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    sketch = docs.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema)
    counts = np.zeros((PARTS, width), dtype=np.uint64)
    for row in sketch.collect():
        counts[row.part] = np.frombuffer(row.counts, dtype=np.uint64)
    return _levels(counts.ravel())


def _levels(counts: np.ndarray) -> np.ndarray:
    usual = np.median(counts)
    over = (counts - usual) / (np.sqrt(usual) + 1)
    return np.floor(np.log2(np.maximum(over, 0.5)) + 1).astype(np.uint8)


def _prefix(tokens: np.ndarray, levels: np.ndarray, n: int) -> np.ndarray:
    level = levels[tokens >> np.uint64(44)]
    return tokens[np.argsort(level, kind="stable")[:n]] if level.any() else tokens[:n]


def described(docs: DataFrame, k: int, rule: Rule) -> DataFrame:
    """For every row: id, size of its set, the set's signature and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in words.pieces(batches, "text", 1 << 22):
            hashed, bounds = words.hashed(batch.column("text"), lower=True)
            n, least, sig, prefix = [], [], [], []
            for tokens in words.shingle_sets(hashed, bounds, k):
                n.append(len(tokens))
                least.append(rule.least(len(tokens)))
                sig.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                prefix.append(_prefix(tokens, levels, rule.prefix(len(tokens))).view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            columns = [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(least, pa.int32())]
            columns += [pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_n", "_least", "_sig", "_prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(describe, _IDS)


def _bit(i: Column) -> Column:
    """The id's bit, from 1."""
    return F.pmod(F.xxhash64(i), F.lit(BITS)) + 1


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``_id`` is in ``wanted``, and a few others: those that share a bit with one that is.

    The bits have a fixed size, whatever the input's; they spare the other rows' texts the way to a join.
    """
    bit = _bit(F.col("_id"))
    bits = wanted.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits")
    )
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "_bucket")
    return near.where(F.bit_get(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(_id, _in, _set): the whole sets, as bytes, of the rows in ``wanted`` (_id, _sig, _in).

    ``_in`` is a long that goes along. A repeated id is told apart by the signature.

    Rows that repeat an id and text come out once for each task they meet in; the steps after allow for that.
    """
    rows = _likely(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"), wanted).join(wanted, "_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, bytes]] = set()
        for batch in words.pieces(batches, "text", 1 << 22):
            hashed, bounds = words.hashed(batch.column("text"), lower=True)
            keys = list(zip(batch.column("_id").to_pylist(), batch.column("_sig").to_pylist(), strict=True))
            sets, own = [], []
            for key, tokens in zip(keys, words.shingle_sets(hashed, bounds, k), strict=True):
                sets.append(tokens.tobytes())
                own.append(key not in done and hashlib.blake2b(sets[-1], digest_size=16).digest() == key[1])
                if own[-1]:
                    done.add(key)
            columns = [batch.column("_id"), batch.column("_in"), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_in", "_set"]).filter(pa.array(own, pa.bool_()))

    return rows.select("_id", "_sig", "_in", "text").mapInArrow(gather, "_id long, _in long, _set binary")


class Forest:
    """Components of a task's few thousand items."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(self.of[np.append(others, a)])
        if len(roots) > 1:
            self.of[np.isin(self.of, roots)] = roots[0]


def _members(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group's token union, every member's tokens as places in it, their bounds and sizes."""
    arrays = [np.frombuffer(s, dtype=np.uint64) for s in sets]
    sizes = np.array([len(a) for a in arrays])
    union, place = np.unique(np.concatenate(arrays), return_inverse=True)
    return union, place, np.concatenate([[0], np.cumsum(sizes)]), sizes


def _open(marked: np.ndarray, place: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Tokens that each of the members ``which`` shares with what is marked in the union."""
    if len(which) * 2 > len(bounds) - 1:
        return np.add.reduceat(marked[place], bounds[:-1], dtype=np.int64)[which]
    return np.array([marked[place[bounds[i] : bounds[i + 1]]].sum(dtype=np.int64) for i in which], dtype=np.int64)


def _links_inside(rule: Rule):
    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        ids, a, b = table.column("_id").to_numpy(), [], []
        _, place, bounds, sizes = _members(table.column("_set").to_pylist())
        forest, marked = Forest(len(ids)), np.zeros(int(place.max()) + 1, dtype=np.uint8)
        for q in range(len(ids)):
            rest = np.flatnonzero(forest.of != forest.of[q])
            if not len(rest):
                break
            fits = (100 * sizes[rest] >= rule.percent * sizes[q]) & (100 * sizes[q] >= rule.percent * sizes[rest])
            rest = rest[fits & (rest > q)]
            if not len(rest):
                continue
            own = place[bounds[q] : bounds[q + 1]]
            marked[own] = 1
            hits = rest[rule.linked(_open(marked, place, bounds, rest), sizes[q], sizes[rest])]
            marked[own] = 0
            _, first = np.unique(forest.of[hits], return_index=True)
            a.extend(ids[hits[first]])  # links lead to the smaller id, so that the first of a component is never ``a``
            b.extend(ids[q] for _ in first)
            forest.join(q, hits)
        roots = pd.Series(ids).groupby(forest.of).transform("first")
        a.extend(ids)  # each member and the first of its component: also a member that stays alone
        b.extend(roots)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _links_between(rule: Rule):
    def link(table: pa.Table) -> pa.Table:
        members, queries = table.filter(pc.invert(table.column("_asks"))), table.filter(table.column("_asks"))
        a, b = [], []
        if members.num_rows and queries.num_rows:
            ids, of = members.column("_id").to_numpy(), members.column("_c").to_numpy()
            union, place, bounds, sizes = _members(members.column("_set").to_pylist())
            marked = np.zeros(len(union), dtype=np.uint8)
            columns = (queries.column(c).to_pylist() for c in ("_id", "_c", "_set"))
            for query, component, tokens in zip(*columns, strict=True):
                tokens = np.frombuffer(tokens, dtype=np.uint64)
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                own = at[union[at] == tokens]
                n = len(tokens)
                if 100 * len(own) < rule.percent * n:
                    continue  # the union's overlap bounds that with any member: the group stays closed
                fits = (100 * sizes >= rule.percent * n) & (100 * n >= rule.percent * sizes) & (of != component)
                rest = np.flatnonzero(fits)
                if not len(rest):
                    continue
                marked[own] = 1
                hits = rest[rule.linked(_open(marked, place, bounds, rest), n, sizes[rest])]
                marked[own] = 0
                _, first = np.unique(of[hits], return_index=True)
                a.extend(query for _ in first)
                b.extend(ids[hits[first]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _chunked(rows: DataFrame, group: int) -> DataFrame:
    """Rows with their group ``_g`` (the key, in as many chunks as its rows need) and whether it was ``_split``.

    Where rows have the size of their set, ``_n``, long sets need more chunks.
    """
    size = F.ceil(F.col("_n") / TOKENS) if "_n" in rows.columns else F.lit(1)
    counts = rows.groupBy("_key").agg(F.sum(size).alias("_rows")).where(F.col("_rows") > group)
    chunk = F.coalesce(F.pmod(F.xxhash64("_id"), F.ceil(F.col("_rows") / group)), F.lit(0))
    grouped = rows.join(counts, "_key", "left").withColumn("_split", F.col("_rows").isNotNull())
    return grouped.withColumn("_g", F.xxhash64("_key", chunk)).drop("_rows")


def _inside(sets: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """Links, and (member, first of its component), of the groups of ``wanted`` (_id, _g) with more than one member."""
    several = wanted.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_g")
    wanted = settled(wanted.select("_id", "_g").join(several, "_g"), "inside")
    rows = sets.select("_id", "_set").hint("merge").join(wanted, "_id")
    return rows.groupBy("_g").applyInArrow(_links_inside(rule), _LINKS)


def _regrouped(sets: DataFrame, round_: DataFrame, found: DataFrame, rule: Rule, group: int) -> DataFrame:
    """``found`` and the links between first members of the components of split groups (_id, _key, _split, maybe _n)."""
    while True:  # the first members of a split group's components are grouped anew, until one group is left
        later = found.where("a <> b").select(F.col("a").alias("_id"))
        firsts = round_.where("_split").select([c for c in ("_id", "_key", "_n") if c in round_.columns]).join(later, "_id", "left_anti")
        again = settled(_chunked(firsts, group), "firsts")
        if again.isEmpty() or again.count() >= round_.count():
            break
        found = settled(found.union(_inside(sets, again, rule)), "links")
        round_ = again
    return found


def _opened(sets: DataFrame, state: DataFrame, pairs: DataFrame, rule: Rule, group: int) -> DataFrame:
    """Links between the sets of ``pairs`` (_id, _to, _c) and the members of the groups ``_to`` that they query.

    ``state`` (_id, _c, _g) has every member's groups and its component so far.
    """
    # Every set goes to the groups it queries, and to its own if that is queried, in slices of the queries.
    chunks = pairs.groupBy(F.col("_to").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / (2 * group)).alias("_k"))
    asks = pairs.withColumnRenamed("_to", "_g").join(chunks, "_g")
    asks = asks.select("_id", "_c", "_g", F.pmod(F.xxhash64("_id"), F.col("_k")).alias("_part"), F.lit(True).alias("_asks"))
    owns = state.select("_id", "_c", "_g").join(chunks, "_g")
    owns = owns.select("_id", "_c", "_g", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_part"), F.lit(False).alias("_asks"))
    roles = asks.union(owns).groupBy("_id", "_c").agg(F.collect_list(F.struct("_g", "_part", "_asks")).alias("_roles"))
    sent = sets.hint("merge").join(settled(roles, "roles"), "_id").select("_id", "_c", "_set", F.inline("_roles"))
    return sent.groupBy("_g", "_part").applyInArrow(_links_between(rule), _LINKS)


def _candidates(unique: DataFrame) -> DataFrame:
    """(_id, _tokens, _key, ...): the sets that may have a partner, the tokens of their prefix that other sets' have
    too, and the one of these that most sets have (of several the smallest).

    Sets that share frequent tokens, similar or not, so meet in few groups, which the matrix then has for each token.
    Tokens are dealt out once; the count of their sets and the way back use the same exchange.
    """
    tokens = unique.where("_n > 0").select("_id", F.explode("_prefix").alias("_t")).repartition("_t")
    shared = tokens.groupBy("_t").agg(F.min("_id").alias("_l"), F.max("_id").alias("_h"), F.count(F.lit(1)).alias("_m"))
    postings = tokens.join(shared.where("_l <> _h").select("_t", "_m"), "_t")
    most = F.min(F.struct((-F.col("_m")).alias("_m"), "_t"))["_t"]
    per_set = postings.groupBy("_id").agg(F.collect_list("_t").alias("_tokens"), most.alias("_key"))
    rows = per_set.join(unique.select("_id", "_n", "_least", "_sig"), "_id")
    return rows.where(F.size("_tokens") >= F.col("_least"))


def _links(docs: DataFrame, unique: DataFrame, k: int, rule: Rule, group: int) -> DataFrame:
    """Links (a, b) between sets, enough to join every component; ``unique`` has a row for each different set, and is
    dropped once its prefixes have been read.

    Whole sets are made once, for the candidates only. What each step wants of them is worked out on ids and written
    first, so that the sets themselves move no more than once for each step.
    """
    near = settled(_chunked(_candidates(unique), group), "candidates")
    drop(unique)
    several = near.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_g", F.col("_g").alias("_in"))
    wanted = settled(near.select("_id", "_sig", "_g").join(several, "_g", "left").drop("_g"), "wanted")
    sets = settled(_with_sets(docs, wanted, k), "sets")

    # The groups of the first round travel with the sets.
    first = sets.where("_in is not null").select("_id", F.col("_in").alias("_g"), "_set")
    found = settled(first.groupBy("_g").applyInArrow(_links_inside(rule), _LINKS), "links")
    found = _regrouped(sets, near, found, rule, group)
    known = components(found).select(F.col("id").alias("_id"), "component")
    state = near.join(known, "_id", "left").withColumn("_c", F.coalesce("component", "_id"))
    state = settled(state.select("_id", "_n", "_least", "_g", "_c", "_tokens"), "grouped")

    rows = state.select("_id", "_n", "_least", "_g", "_c", F.explode("_tokens").alias("_t"))
    mixed = rows.groupBy("_t").agg(F.min("_c").alias("_l"), F.max("_c").alias("_h")).where("_l <> _h").select("_t")
    rows = rows.join(mixed, "_t", "left_semi")
    matrix = rows.groupBy("_t", "_g").agg(
        F.min("_n").alias("_low"), F.max("_n").alias("_high"), F.min("_c").alias("_cl"), F.max("_c").alias("_ch")
    )
    matrix = matrix.withColumnRenamed("_g", "_to")
    new = (F.col("_g") > F.col("_to")) & ~((F.col("_cl") == F.col("_c")) & (F.col("_ch") == F.col("_c")))
    pairs = rows.join(matrix, "_t").where(new & rule.sizes(F.col("_n"), F.col("_low"), F.col("_high")))
    pairs = pairs.groupBy("_id", "_to", "_c", "_least").agg(F.count(F.lit(1)).alias("_common"))
    pairs = settled(pairs.where("_common >= _least").select("_id", "_to", "_c"), "pairs")

    opened = _opened(sets.drop("_in"), state, pairs, rule, group)
    out = settled(found.union(opened), "links")
    drop(near, wanted, sets, state, pairs, found)
    return out


def join_components(docs: DataFrame, k: int = 5, percent: int = 80, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A set is the distinct ``k``-word shingles of the whole text, A-Z lower-cased; fewer words are one shingle. Two
    documents link when 100 * intersection >= percent * union; ``component_id`` is the smallest doc_id reachable.
    Null, empty and blank texts have an empty set and are linked with nothing. Rows with a null doc_id are linked with
    nothing and have a null component. A repeated doc_id gives one row for each of its rows, each by its own text.
    """
    rule = Rule(percent)
    docs = docs.select("doc_id", "text")
    whole = settled(described(docs, k, rule), "described")
    all_rows = settled(whole.select("_id", "_n", "_sig"), "rows")
    real = whole.where("_n > 0 and _id is not null")
    unique = real.groupBy("_sig").agg(
        F.min("_id").alias("_id"), *(F.first(c).alias(c) for c in ("_n", "_least", "_prefix"))
    )
    unique = settled(unique, "unique")
    drop(whole)
    ids = settled(unique.select("_sig", F.col("_id").alias("id")), "ids")
    linked = components(_links(docs, unique, k, rule, group))
    of = ids.join(linked, "id", "left")
    of = of.select("_sig", F.coalesce("component", "id").alias("component"))
    out = all_rows.select("_id", "_n", F.when((F.col("_n") > 0) & F.col("_id").isNotNull(), F.col("_sig")).alias("_sig"))
    out = out.join(of, "_sig", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_shingles"), component.alias("component_id"))
