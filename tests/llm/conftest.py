import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, score double, lines_total int, _bucket string"

LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(20_000))


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and clashing column names."""
    same = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (1, same, "en", "a"),
        (2, same, "en", "b"),
        (2, same, "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, "a"),
        (5, " \t\n\x0b ", "fr", None),
        (6, "Solo", "en", None),
        (7, LONG, "en", "a"),
        (8, LONG + " end", "en", "a"),
        (9, "12345 !!! 678", "en", "c"),
        (10, "été à la plage\nété à la plage\n\nOne LINE more", "fr", "c"),
        (None, same, None, None),
        (None, None, None, None),
        (11, same.upper(), "en", "a"),
        (12, "one two three four", None, "b"),
    ]
    return [(i, t, lang, source, None, "x", 1.0, None, None) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shape(df):
    return [(f.name, f.dataType) for f in df.schema if not isinstance(f.dataType, T.NullType)]
