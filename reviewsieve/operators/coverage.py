"""Feature coverage: how much of a topic's feature variance the labelled articles span.

Coverage of a prefix of the review order is the mean, over all features, of the prefix's
variance over the topic's variance, in percent and at most 100. The order is cut into
blocks of positions. Each block is summed up, the sums of earlier blocks are carried in,
and running variances are then taken inside each block by numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import sums_before
from reviewsieve.operators.pool import RUN, reveal_positions
from reviewsieve.session import cut_lineage, fresh

BLOCK = 1024
# Fixed value: stands in for a variance of zero on either side.
NO_VARIANCE = 1e-10
_BLOCK_SUMS = "n bigint, mean array<double>, m2 array<double>, lo array<double>, hi array<double>"


def topic_moments(features: DataFrame) -> DataFrame:
    """Mean and population variance of every feature: ``topic, centre, spread``."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features"))
    n = F.col("_s.count")
    return features.groupBy("topic").agg(summary.alias("_s")).select(
        "topic",
        vector_to_array(F.col("_s.mean")).alias("centre"),
        F.transform(
            vector_to_array(F.col("_s.variance")), lambda v: v * (n - 1) / n
        ).alias("spread"),
    )


def _sum_block(rows: pd.DataFrame) -> pd.DataFrame:
    values = np.stack(rows["features"].to_numpy())
    mean = values.mean(axis=0)
    out = rows[[*RUN, "_block"]].iloc[:1].copy()
    out["n"] = len(values)
    for name, value in (
        ("mean", mean),
        ("m2", ((values - mean) ** 2).sum(axis=0)),
        ("lo", values.min(axis=0)),
        ("hi", values.max(axis=0)),
    ):
        out[name] = [value]
    return out


def _run_block(rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or carried.empty:
        empty = rows[[*RUN, "pos"]].iloc[:0]
        return empty.assign(coverage_pct=pd.Series(dtype="float64"))
    rows = rows.sort_values("pos", ignore_index=True)
    head = carried.iloc[0]
    values = np.stack(rows["features"].to_numpy())
    shifted = values - head["centre"]
    n = (int(head["n"]) + np.arange(1, len(values) + 1))[:, None]
    first = np.cumsum(shifted, axis=0) + head["s1"]
    second = np.cumsum(shifted**2, axis=0) + head["s2"]
    low = np.minimum(np.minimum.accumulate(values), head["lo"])
    high = np.maximum(np.maximum.accumulate(values), head["hi"])
    variance = np.maximum(second / n - (first / n) ** 2, 0.0)
    variance[(low == high) | (variance == 0)] = NO_VARIANCE
    whole = np.array(head["spread"])
    whole[whole == 0] = NO_VARIANCE
    share = np.minimum((variance / whole).mean(axis=1) * 100, 100.0)
    return rows.loc[rows["_wanted"], [*RUN, "pos"]].assign(
        coverage_pct=share[rows["_wanted"].to_numpy()]
    )


def _carried(sums: DataFrame, moments: DataFrame) -> DataFrame:
    """Per block, the moments of all earlier blocks about the topic's centre."""
    spread_out = sums.join(moments, "topic").select(
        *RUN, "_block", "n",
        F.posexplode(F.arrays_zip("mean", "m2", "lo", "hi", "centre", "spread")).alias("dim", "v"),
    )
    gap = F.col("v.mean") - F.col("v.centre")
    earlier = (
        Window.partitionBy(*RUN, "dim").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0.0)
    rows = spread_out.select(
        *RUN, "_block", "dim", "v.centre", "v.spread",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("n") * gap).over(earlier), zero).alias("s1"),
        F.coalesce(F.sum(F.col("v.m2") + F.col("n") * gap * gap).over(earlier), zero).alias("s2"),
        F.coalesce(F.min("v.lo").over(earlier), F.lit(float("inf"))).alias("lo"),
        F.coalesce(F.max("v.hi").over(earlier), F.lit(float("-inf"))).alias("hi"),
    )
    names = ["s1", "s2", "lo", "hi", "centre", "spread"]
    gathered = rows.groupBy(*RUN, "_block").agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("dim", *names))).alias("_dims"),
    )
    return gathered.select(
        *RUN, "_block", "n", *[F.col(f"_dims.{name}").alias(name) for name in names]
    )


def coverage_curve(
    log: DataFrame, features: DataFrame, prefix: str = "index", block: int = BLOCK
) -> DataFrame:
    """``topic, policy, run, round, coverage_pct``, one row per round after the seeds.

    ``prefix="index"``: round r looks at the first r labelled articles. ``prefix="round"``:
    it looks at all articles labelled before it, the ones that effort counts. Before the
    first article coverage is 0; it is null where the last article looked at has no features.
    """
    if prefix not in ("index", "round"):
        raise ValueError("prefix is 'index' or 'round'")
    placed = reveal_positions(log).select(*RUN, "round", "pos", "pmid")
    rounds = log.groupBy(*RUN, "round").agg(F.count(F.lit(1)).alias("_n"))
    if prefix == "index":
        points = rounds.select(*RUN, "round", F.col("round").cast("bigint").alias("pos"))
        last = rounds.groupBy(*RUN).agg(F.max("round").alias("_last"))
        placed = placed.join(last, RUN).where(F.col("pos") <= F.col("_last")).drop("_last")
    else:
        points = sums_before(rounds, RUN, "round", {"pos": "_n"}).select(*RUN, "round", "pos")
    points = points.where(F.col("round") > 0)
    wanted = points.select(*RUN, "pos", F.lit(True).alias("_wanted")).distinct()
    rows = (
        placed.join(wanted, [*RUN, "pos"], "left")
        .join(features.select("topic", "pmid", "features"), ["topic", "pmid"])
        .select(
            *RUN, "pos", "features", F.coalesce("_wanted", F.lit(False)).alias("_wanted"),
            F.floor((F.col("pos") - 1) / F.lit(block)).alias("_block"),
        )
    )
    rows = cut_lineage(rows)  # read twice, to sum the blocks and to run through them
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    run_schema = ", ".join(f"{c} {types[c]}" for c in RUN)
    cell = [*RUN, "_block"]
    sums = rows.groupBy(*cell).applyInPandas(
        _sum_block, f"{run_schema}, _block bigint, {_BLOCK_SUMS}"
    )
    carried = _carried(sums, topic_moments(features))
    values = (
        rows.groupBy(*cell)
        .cogroup(fresh(carried).groupBy(*cell))
        .applyInPandas(_run_block, f"{run_schema}, pos bigint, coverage_pct double")
    )
    nothing = F.when(F.col("pos") == 0, F.lit(0.0))
    return points.join(values, [*RUN, "pos"], "left").select(
        *RUN, "round", F.coalesce("coverage_pct", nothing).alias("coverage_pct")
    )
