"""Column expressions. All are built-ins, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed


def instant(column: Column | str, strict: bool = True) -> Column:
    """UTC instant from a string or timestamp. Strict raises on unreadable text, else NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.to_timestamp(c) if strict else F.try_to_timestamp(c)


def utc_day(column: Column | str, strict: bool = True) -> Column:
    """UTC calendar day of a string or timestamp (the session time zone must be UTC)."""
    return F.to_date(instant(column, strict))


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, the integer axis for range frames."""
    return F.unix_date(day)


def issue_text(title: Column, body: Column) -> Column:
    """Title, one blank, body; a missing part is empty but the blank stays."""
    empty = F.lit("")
    return F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(body, empty))


def author_category(column: Column) -> Column:
    return F.upper(F.coalesce(column, F.lit("NONE")))


def author_flags(column: Column, categories: Sequence[str] = fixed.AUTHOR_CATEGORIES) -> list[Column]:
    """One 0/1 integer per known category, in order. Anything else gives all zeros."""
    category = author_category(column)
    return [(category == c).cast("int").alias(f"is_{c.lower()}") for c in categories]


def signal_log(column: Column) -> Column:
    """log(1 + x), with a missing signal taken as 0."""
    return F.log1p(F.coalesce(column.cast("double"), F.lit(0.0)))


def label_id(column: Column, labels: Sequence[str] = fixed.LABELS) -> Column:
    """Position of the label in the fixed order; raises on any other value."""
    position = F.array_position(F.array(*[F.lit(v) for v in labels]), column) - 1
    known = column.isin(*labels)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(column, F.lit("NULL"))))
    return F.when(known, position.cast("int")).otherwise(unknown.cast("int"))


def label_name(column: Column, labels: Sequence[str] = fixed.LABELS) -> Column:
    """Label of an id; NULL for a NULL id and for one that no label has."""
    return F.get(F.array(*[F.lit(v) for v in labels]), column.cast("int"))


def argmax(scores: Column) -> Column:
    """Index of the highest score, the first one on ties. NULL without scores, or where one is NULL or NaN."""
    whole = F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size(scores) > 0)
    return F.when(whole, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def bucket_fraction(key: Column, seed: int = fixed.SEED) -> Column:
    """Uniform number in [0, 1) that depends on the key and seed only.

    Unlike ``rand`` or ``sampleBy`` it gives the same rows in every layout and on every retry.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def require_labels(df: DataFrame, column: str = "label", labels: Sequence[str] = fixed.LABELS) -> DataFrame:
    """Rows unchanged; the job fails and names the value when a label is not one of ``labels``.

    The check runs inside the same pass over the data.
    """
    return df.withColumn(column, label_name(label_id(F.col(column), labels), labels))
