"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.session import broadcast_if_small, cut_lineage

# Keys with so many rows are split off, however many such keys there are.
HOT_MIN_ROWS = 1_000_000


def hot_keys(
    df: DataFrame, keys: list[str], min_rows: int = HOT_MIN_ROWS
) -> DataFrame | None:
    """All keys with ``min_rows`` rows or more, as a written table; None if there are none.

    Counted when the plan is built, on the key columns alone. There are at most
    rows / ``min_rows`` of them.
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = cut_lineage(counts.where(F.col("_rows") >= min_rows).select(*keys))
    return broadcast_if_small(hot) if hot.limit(1).count() else None


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Left or inner join to a table with one row per key.

    Without hot keys it is the plain join. Otherwise rows of hot keys stay where they are
    and meet their partners, one row for each hot key, by broadcast if those are few; all
    other rows are shuffled, with no key above ``min_rows``.
    """
    hot = hot_keys(left, keys, min_rows)
    if hot is None:
        return left.join(right, keys, how)
    few = broadcast_if_small(right.join(hot, keys, "left_semi"))
    spread = left.join(hot, keys, "left_semi").join(few, keys, how)
    shuffled = left.join(hot, keys, "left_anti").join(right, keys, how)
    return spread.unionByName(shuffled)


def last_version(df: DataFrame, keys: list[str], seq: str, first: str = "first_seq") -> DataFrame:
    """One row per key: the values of the last one, and the place of the first.

    Versions are settled on ``(keys, seq)`` alone; the wide columns are shuffled once, on
    keys and ``seq`` together, so many copies of one key do not meet in one task.
    ``seq`` must be unique within a key.
    """
    ends = df.groupBy(*keys).agg(F.min(seq).alias(first), F.max(seq).alias(seq))
    return df.join(ends, [*keys, seq])
