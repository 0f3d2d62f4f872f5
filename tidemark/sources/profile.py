"""Schema and row-count report for a set of datasets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_profile(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """One row per dataset column: dataset, n_rows, position, column_name, column_type.

    Schemas come from metadata; each dataset is counted once, with no column read.
    """
    parts = []
    for name, df in datasets.items():
        fields = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("column_type"),
                )
                for i, f in enumerate(df.schema.fields, start=1)
            ]
        )
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("dataset"), "n_rows", F.inline(fields)))
    return reduce(DataFrame.unionByName, parts)
