"""Dense-vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vectors(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """Mean vector and row count per group: ``(keys, n, mean)``.

    One ``avg`` per dimension: fixed-width buffers that are combined before the shuffle.
    """
    means = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"avg(cast({vector}[{i}] as double)) as _m{i}") for i in range(size)],
    )
    parts = ", ".join(f"_m{i}" for i in range(size))
    return means.select(*keys, "n", F.expr(f"array({parts})").alias("mean"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def vector_size(df: DataFrame, vector: str) -> int:
    """Width of the vectors, checked to be the same in every row."""
    row = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if row.lo is None:
        raise ValueError("no vectors given")
    if row.lo != row.hi:
        raise ValueError(f"vectors differ in width: {row.lo} to {row.hi}")
    return row.hi
