"""Text features as array expressions on the row: nothing here shuffles.

A text lives on one row, so its terms can be counted there. Exploding terms and grouping them
again would send about three times the text volume through a shuffle to learn nothing new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores, of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank; ``words`` should be a column, not an expression."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    following = F.slice(words, F.lit(2), pairs)
    return F.zip_with(F.slice(words, F.lit(1), pairs), following, lambda a, b: F.concat(a, F.lit(" "), b))


def terms(text: Column) -> Column:
    """Words, then neighbouring word pairs."""
    return bind(tokens(text), lambda words: F.concat(words, bigrams(words)))


def run_starts(ordered: Column) -> Column:
    """Places (from 0) where the value of a sorted array changes; the first place is one."""
    places = F.slice(F.sequence(F.lit(0), F.size(ordered)), F.lit(1), F.size(ordered))
    return F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))


def run_lengths(starts: Column, length: Column) -> Column:
    """Length of each run of a sorted array of the given length."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(length))
    return F.slice(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(1), F.size(starts))


def counted(values: Column, name: str = "term") -> Column:
    """Array of (value, n), one entry per distinct value, in value order.

    Sorting puts equal values side by side; a run's length is the distance between the places
    where the value changes. O(n log n) in the length of the array.
    """

    def runs(ordered: Column) -> Column:
        entry = lambda i, n: F.struct(F.get(ordered, i).alias(name), n.cast("long").alias("n"))
        return bind(
            run_starts(ordered),
            lambda starts: F.zip_with(starts, run_lengths(starts, F.size(ordered)), entry),
        )

    return bind(F.sort_array(values), runs)


def bucket_murmur(term: Column, buckets: int = fixed.HASH_BUCKETS) -> Column:
    """Hash bucket of a term, cheap form."""
    if buckets & (buckets - 1) == 0:
        # Same as the modulus for a power of two, and never NULL: the buckets sort as plain ints.
        return F.hash(term).bitwiseAND(F.lit(buckets - 1))
    return F.pmod(F.hash(term), F.lit(buckets))


def bucket_md5(term: Column, buckets: int = fixed.HASH_BUCKETS) -> Column:
    """Hash bucket of a term that other engines can reproduce: md5's first 8 hex digits."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hashed_counts(text: Column, bucket: Callable[[Column], Column] = bucket_murmur) -> Column:
    """Array of (bucket, n) over words and word pairs; terms sharing a bucket add up."""
    return counted(F.transform(terms(text), lambda t: bucket(t)), "bucket")


def l2_weights(counts: Column, name: str = "bucket") -> Column:
    """Array of (bucket, weight) scaled to unit length; an empty array stays empty."""

    def scaled(entries: Column) -> Column:
        squares = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + (e["n"] * e["n"]).cast("double"))
        return bind(
            F.sqrt(squares),
            lambda norm: F.transform(
                entries, lambda e: F.struct(e[name].alias(name), (e["n"] / norm).alias("weight"))
            ),
        )

    return bind(counts, scaled)


def capped(words: Column, limit: int = fixed.MAX_TOKENS) -> Column:
    """The tokens a length-limited model takes in. The text is tokenised whole first."""
    return F.slice(words, 1, limit)
