"""Language identification by prediction by partial matching (PPM, escape method C, no exclusion).

Per language a tree of byte contexts of 0 to ``ORDER`` bytes is counted in Spark from a bounded sample of labelled
texts and then frozen. A text's code length under a language is exact for these statistics: each byte is coded in its
longest known context, with an escape wherever the byte is new to the context. The shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words

#: Longest context, in bytes. A context and its byte must fit in eight.
ORDER = 5
#: Bounds of the training sample over all languages: texts, and bytes of text.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 4_000_000
#: The prediction for texts without a letter.
UNDETERMINED = "und"
LETTER = r"\p{L}"

#: Stands before a text; no UTF-8 text holds this byte.
_EDGE = 0xFF
_KEYS = "lang string, depth int, gram long, n long"


def training_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, total_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text): per language whole texts in the order of a hash of the text, up to an equal share of ``rows`` and
    ``total_bytes``, one text at least. Texts longer than the share of bytes are left out; a language that has no
    others is sampled by the beginning of one of them, a quarter as many characters as the share has bytes.

    Rows with a null text or language are left out, equal texts of a language count once. Only hashes and lengths
    are ranked, thinned by a hash first, so that no window sees many more rows than it keeps. Two tables are
    broadcast: a row for each language, and the keys kept (``rows`` at most, or one a language); texts aren't shuffled.
    """
    known = labelled.where("text is not null and lang is not null and text <> ''").select("text", "lang")
    languages = max(1, known.select("lang").distinct().count())
    share, most = max(1, rows // languages), max(1, total_bytes // languages)
    known = known.withColumns({"_h": F.xxhash64("text"), "_b": F.octet_length("text")})
    fits, key = F.col("_b") <= most, F.struct("_h", "_b")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.when(fits, F.col("_h"))).alias("_n"), F.max(fits).alias("_some"), F.min(key).alias("_first"))
    # The summand keeps texts of every language where the share is a text or two.
    rates = counts.select("lang", "_some", "_first", F.least(F.lit(1.0), F.lit(2.0 * share + 64) / F.greatest("_n", F.lit(1))).alias("_rate"))
    thinned = known.select("lang", "_h", "_b").join(F.broadcast(rates), "lang")
    drawn = (F.pmod("_h", F.lit(1 << 30)) / (1 << 30)) < F.col("_rate")
    thinned = thinned.where(F.when(F.col("_some"), fits & drawn).otherwise(key == F.col("_first")))
    order = Window.partitionBy("lang").orderBy("_h", "_b")
    kept = (
        thinned.select("lang", "_h", "_b")
        .distinct()
        .withColumns({"_rank": F.row_number().over(order), "_sum": F.sum("_b").over(order)})
        .where((F.col("_rank") == 1) | ((F.col("_rank") <= share) & (F.col("_sum") <= most)))
        .select("lang", "_h", "_b")
    )
    texts = known.join(F.broadcast(kept), ["lang", "_h", "_b"]).dropDuplicates(["lang", "_h", "_b"])
    part = F.substring("text", 1, max(1, most // 4))  # a character has four bytes at most
    return texts.select("lang", F.when(fits, F.col("text")).otherwise(part).alias("text"))


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """For every byte, the ``order`` bytes before it and itself, as one number; short contexts are filled by the edge."""
    gram = data.astype(np.uint64)
    filled = np.diff(bounds) > 0
    starts, ends = bounds[:-1][filled], bounds[1:][filled]
    for back in range(1, order + 1):
        before = np.full(len(data), _EDGE, dtype=np.uint64)
        before[back:] = data[:-back]
        for into in range(back):  # the first bytes of a text have nothing of the text before
            head = starts + into
            before[head[head < ends]] = _EDGE
        gram |= before << np.uint64(8 * back)
    return gram


def context_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, depth, gram, n): how often each byte followed each context of ``depth`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, "text", 1 << 20):
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                data, bounds = words.raw(batch.column("text").filter(pa.array(langs == lang)))
                full = _grams(data, bounds, order)
                for depth in range(order + 1):
                    gram, n = np.unique(full & np.uint64((1 << (8 * (depth + 1))) - 1), return_counts=True)
                    columns = [[lang] * len(gram), np.full(len(gram), depth, np.int32), gram.view(np.int64), n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lang", "depth", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, _KEYS)
    return counts.groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """What is known of one context length: sorted keys, with bits for each language in their rows."""

    grams: np.ndarray
    bits: np.ndarray  # of the byte, all shorter contexts included
    contexts: np.ndarray
    escapes: np.ndarray  # bits of leaving the context; 0 where a language does not know it


@dataclass
class Model:
    """Frozen statistics of all languages. Its size is bounded by the training sample's (see ``SAMPLE_BYTES``)."""

    languages: list[str]
    order: int
    levels: list[Level]

    def __post_init__(self) -> None:
        self.slot_bits = max(8, int(len(self.levels[-1].grams)).bit_length() + 2) if self.levels else 8
        self.slots: np.ndarray | None = None

    def _bits(self, gram: np.ndarray, depth: int) -> np.ndarray:
        """Bits of distinct grams of ``depth`` context bytes: one row for each, one column for each language."""
        if depth < 0:
            return np.full((len(gram), len(self.languages)), 8.0, dtype=np.float32)
        level = self.levels[depth]
        at = np.minimum(np.searchsorted(level.grams, gram), len(level.grams) - 1)
        known = level.grams[at] == gram
        out = np.empty((len(gram), len(self.languages)), dtype=np.float32)
        out[known] = level.bits[at[known]]
        if not known.all():
            rest = gram[~known]
            context = rest >> np.uint64(8)
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            escape = np.where((level.contexts[at] == context)[:, None], level.escapes[at], np.float32(0))
            lower = rest & np.uint64((1 << (8 * depth)) - 1) if depth else rest
            shorter, inverse = np.unique(lower, return_inverse=True)
            out[~known] = self._bits(shorter, depth - 1)[inverse] + escape
        return out

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        data, bounds = words.raw(column)
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        top = self.levels[-1]
        if self.slots is None:  # most grams are found by one look into this table
            self.slots = np.zeros(1 << self.slot_bits, dtype=np.int32)
            self.slots[self._slot(top.grams)] = np.arange(len(top.grams), dtype=np.int32)
        filled = np.flatnonzero(np.diff(bounds))
        begins = bounds[:-1][filled]
        step = max(1 << 12, (1 << 20) // max(1, len(self.languages)))
        for start in range(0, len(data), step):
            stop = min(len(data), start + step)
            low = max(0, start - self.order)
            cut = np.unique(np.clip(bounds, low, stop)) - low
            # A text that begins before ``low`` is cut at ``low``: the bytes kept are all the context there is.
            gram = _grams(data[low:stop], cut if cut[0] == 0 else np.insert(cut, 0, 0), self.order)[start - low :]
            at = self.slots[self._slot(gram)]
            hit = top.grams[at] == gram
            bits = top.bits[at]
            if not hit.all():
                missed, inverse = np.unique(gram[~hit], return_inverse=True)
                bits[~hit] = self._bits(missed, self.order)[inverse]
            here = slice(np.searchsorted(begins, start, side="right") - 1, np.searchsorted(begins, stop))
            heads = np.maximum(begins[here] - start, 0)
            total[filled[here]] += np.add.reduceat(bits, heads, axis=0, dtype=np.float64)
        return total

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return words.mixed(gram) >> np.uint64(64 - self.slot_bits)


def fit(labelled: DataFrame, order: int = ORDER, rows: int = SAMPLE_ROWS, total_bytes: int = SAMPLE_BYTES) -> Model:
    """Model from rows with ``text`` and ``lang``. Without any labelled text it knows no language."""
    counts = context_counts(training_sample(labelled, rows, total_bytes), order).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    lang = np.searchsorted(np.array(languages, dtype=object), counts.column("lang").to_numpy())
    depth, gram, n = (counts.column(c).to_numpy() for c in ("depth", "gram", "n"))
    gram, levels = gram.view(np.uint64), []
    below = lower_grams = None
    for d in range(order + 1) if languages else ():
        here = depth == d
        g, l, c = gram[here], lang[here], n[here].astype(float)
        grams, at = np.unique(g, return_inverse=True)
        contexts, ctx = np.unique(grams >> np.uint64(8), return_inverse=True)
        count = np.zeros((len(grams), len(languages)))
        count[at, l] = c
        seen, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(seen, ctx, count)
        np.add.at(kinds, ctx, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(seen > 0, np.log2((seen + kinds) / kinds), 0.0)
            coded = np.log2((seen + kinds)[ctx] / count)
        if d:
            shorter = below[np.searchsorted(lower_grams, grams & np.uint64((1 << (8 * d)) - 1))]
        else:
            shorter = np.full(count.shape, 8.0)
        below, lower_grams = np.where(count > 0, coded, escapes[ctx] + shorter), grams
        levels.append(Level(grams, below.astype(np.float32), contexts, escapes.astype(np.float32)))
    return Model(languages, order, levels)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, with ``lang_pred`` and ``score``.

    ``score`` is the posterior probability of the predicted language, languages being equally likely before. A text
    that is null, empty or without any letter gives ``und`` and 0, and so does every text if the model knows no
    language. Ties go to the first language in code point order. Texts are read whole, however long.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    # Inside, kept columns have names of their own, so that none can clash. A kept text isn't sent a second time.
    inner = [f"k{i}" for i in range(len(keep))]
    sent_text = inner[keep.index("text")] if "text" in keep else "_text"
    own_text = [] if "text" in keep else [F.when(lettered, F.col("text")).alias("_text")]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), *own_text, lettered.alias("_lettered"))
    kept = rows.select(*inner).schema
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in words.pieces(batches, sent_text, 1 << 23):
            names, score = np.full(batch.num_rows, UNDETERMINED, dtype=object), np.zeros(batch.num_rows)
            told = batch.column("_lettered").to_numpy(zero_copy_only=False)
            if known.languages and told.any():
                text = batch.column(sent_text)
                bits = known.code_lengths(text if told.all() else text.filter(batch.column("_lettered")))
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits[np.arange(len(bits)), best][:, None] - bits, -1000.0)).sum(axis=1)
                names[told], score[told] = np.array(known.languages, dtype=object)[best], 1.0 / odds
            own = [batch.column(c) for c in inner]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(score)], [*inner, "lang_pred", "score"])

    return rows.mapInArrow(score, schema).toDF(*keep, "lang_pred", "score")
