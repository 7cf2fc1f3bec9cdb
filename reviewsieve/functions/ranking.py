"""Ranks, running sums and lags per group, without one task per group.

A window over a whole group puts that group into one task. Here a group is first cut
into buckets that follow the order, the buckets (few and small) are summed up, and the
rows are then ranked inside ``(group, bucket)`` only. All of it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.session import cut_lineage

# Up to this k Spark limits each task's rows before the shuffle of a ranked window.
GROUP_LIMIT = 1000
# Parts a group is spread over before its first k rows meet.
SPREAD = 64
# Hex digits of a draw that name its bucket: 16^3 = 4096 even buckets per group.
DRAW_DIGITS = 3
# Bits of a bucket's number that are summed up together; see _before_in_levels.
LEVEL_BITS = 16


def _div(column: str, width: int) -> Column:
    return F.expr(f"`{column}` div {width}")


def _bucketed(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """``_group``, the keys in one struct, and ``_bucket``; rows without a bucket come first.

    A struct is never null, and structs whose fields are null in the same places are equal:
    so groups with null keys are joined like all others.
    """
    kind = df.select(bucket.alias("b")).schema["b"].dataType.simpleString()
    first = F.lit("") if kind == "string" else F.lit(-(2**62)).cast(kind)
    return df.withColumns(
        {"_group": F.struct(*keys) if keys else F.struct(F.lit(0)), "_bucket": F.coalesce(bucket, first)}
    )


def _before(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per bucket, the totals of all earlier buckets of the same group."""
    totals = df.groupBy("_group", "_bucket").agg(*[c.alias(n) for n, c in sums.items()])
    earlier = (
        Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        "_group", "_bucket",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
    )


def _before_in_levels(df: DataFrame, sums: dict[str, Column], bits: int) -> DataFrame:
    """``_before`` for whole-number buckets of up to ``bits`` bits, however many a group has.

    Buckets are summed up to buckets of ``2^LEVEL_BITS`` numbers, these again, and so on; a bucket
    is then preceded by the earlier ones in its own larger bucket and by what precedes that one.
    So no window holds more than ``2^LEVEL_BITS`` rows.
    """
    totals = df.groupBy("_group", "_bucket").agg(*[c.alias(n) for n, c in sums.items()])
    if bits <= LEVEL_BITS:
        return _before(totals, {n: F.sum(n) for n in sums})
    up = F.shiftright("_bucket", LEVEL_BITS)
    upper = totals.select("_group", up.alias("_bucket"), *sums)
    above = _before_in_levels(upper, {n: F.sum(n) for n in sums}, bits - LEVEL_BITS)
    earlier = (
        Window.partitionBy("_group", "_up").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = totals.withColumn("_up", up).select(
        "_group", "_bucket", "_up",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_in_{n}") for n in sums],
    )
    joined = inside.join(above.withColumnRenamed("_bucket", "_up"), ["_group", "_up"])
    return joined.select("_group", "_bucket", *[(F.col(n) + F.col(f"_in_{n}")).alias(n) for n in sums])


def _rank_in_buckets(
    df: DataFrame, keys: list[str], bucket: Column, order: list, name: str,
    k: int | None = None, bits: int = 0,
) -> DataFrame:
    df = _bucketed(df, keys, bucket)
    count = {"_before": F.count(F.lit(1))}
    before = _before_in_levels(df, count, bits) if bits else _before(df, count)
    if k is not None:
        before = before.where(F.col("_before") < k)
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order)
    ranked = df.join(before, ["_group", "_bucket"]).withColumn(
        name, F.col("_before") + F.row_number().over(inside)
    )
    if k is not None:
        ranked = ranked.where(F.col(name) <= k)
    return ranked.drop("_before", "_group", "_bucket")


def draw_rank(
    df: DataFrame,
    keys: list[str],
    draw: str,
    ties: list[str],
    name: str = "pos",
    k: int | None = None,
) -> DataFrame:
    """Rank 1.. per group in draw order. Draws are uniform, so buckets are even.

    With ``k``, whole buckets behind the k-th row are dropped before the shuffle.
    """
    return _rank_in_buckets(df, keys, F.substring(draw, 1, DRAW_DIGITS), [draw, *ties], name, k)


def id_rank(
    df: DataFrame, keys: list[str], id_col: str, width: int = 65536, name: str = "pos"
) -> DataFrame:
    """Rank 1.. per group by a whole-number id that is distinct within its group.

    A bucket spans ``width`` ids, hence holds at most ``width`` rows. Ids may be sparse, then there
    are as many buckets as ids, so these are counted in levels.
    """
    bits = 64 - (width.bit_length() - 1)
    return _rank_in_buckets(df, keys, _div(id_col, width), [id_col], name, bits=bits)


def range_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Rank 1.. per group in any order.

    Buckets are the parts of a range-partitioned sort. They depend on a sample, so the
    partitioned rows are written once before they are counted and ranked.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in keys], *order)
    parts = cut_lineage(parts.withColumn("_part", F.spark_partition_id()))
    return _rank_in_buckets(parts, keys, F.col("_part"), order, name).drop("_part")


def first_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str, spread_by: str = "pmid"
) -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    For small ``k`` every task keeps at most k rows per group before the shuffle, the rest
    goes to ``SPREAD`` parts of the group that do so again, and at most k rows of each part
    meet in one task. For larger ``k`` the rows are ranked over a range-partitioned sort.
    """
    if k <= GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)))
        for cells in ([*keys, "_salt"], keys):
            window = Window.partitionBy(*cells).orderBy(*order)
            salted = salted.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
        return salted.drop("_salt")
    return range_rank(df, keys, order, name).where(F.col(name) <= k)


def first_k_drawn(
    df: DataFrame, keys: list[str], draw: str, ties: list[str], k: int, name: str
) -> DataFrame:
    """The first ``k`` rows of each group in draw order with their rank."""
    if k <= GROUP_LIMIT:
        return first_k(df, keys, [F.col(draw), *[F.col(t) for t in ties]], k, name, ties[0])
    return draw_rank(df, keys, draw, ties, name, k)


def sums_before(
    df: DataFrame, keys: list[str], step: str, sums: dict[str, str], width: int = 4096
) -> DataFrame:
    """Totals over all rows of the group with a smaller ``step``, this row excluded.

    ``sums`` maps new column to summed column. ``step`` is a whole number, one row each.
    """
    bucketed = _bucketed(df, keys, _div(step, width))
    before = _before(bucketed, {f"_{new}": F.sum(old) for new, old in sums.items()})
    inside = (
        Window.partitionBy("_group", "_bucket")
        .orderBy(step)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = bucketed.join(before, ["_group", "_bucket"])
    for new, old in sums.items():
        within = F.coalesce(F.sum(old).over(inside), F.lit(0))
        out = out.withColumn(new, F.col(f"_{new}") + within)
    return out.drop("_group", "_bucket", *[f"_{new}" for new in sums])


def with_previous(
    df: DataFrame, keys: list[str], step: str, columns: list[str], width: int = 4096
) -> DataFrame:
    """Add ``prev_<column>`` from the row before (null on a group's first row)."""
    bucketed = _bucketed(df, keys, _div(step, width))
    last = bucketed.groupBy("_group", "_bucket").agg(
        F.max(F.struct(step, *columns)).alias("_last")
    )
    by_bucket = Window.partitionBy("_group").orderBy("_bucket")
    carried = last.select("_group", "_bucket", F.lag("_last").over(by_bucket).alias("_carried"))
    inside = Window.partitionBy("_group", "_bucket").orderBy(step)
    row = F.struct(step, *columns)
    out = bucketed.join(carried, ["_group", "_bucket"]).withColumn(
        "_prev", F.coalesce(F.lag(row).over(inside), F.col("_carried"))
    )
    return out.select(
        *df.columns, *[F.col("_prev")[c].alias(f"prev_{c}") for c in columns]
    )
