"""Minimum variance: candidates that raise the labelled set's total variance least.

Adding row x to n rows with mean m and total variance S changes the variance by
``-S/(n+1) + n/(n+1)^2 * |x - m|^2``, so the best row is the one nearest to the mean. The
mean moves with every pick, so k picks are k dependent steps, but it cannot move far: see
``reach``. One pass over a pool finds the few rows that can be picked at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import first_k
from reviewsieve.functions.vectors import distance, mean_vectors, vector_size
from reviewsieve.operators.policies import nearest_to_mean
from reviewsieve.operators.pool import ROUND, RUN
from reviewsieve.session import broadcast_if_small, cut_lineage, fresh

# Drawn batches up to this size are worked on in one task per run; larger ones in passes.
# Both forms compare the same distances and move the mean by the same steps.
BATCH_IN_TASK = 20_000
# Rows with a vector that may be broadcast at once.
WIDE_ROWS = 10_000
# Rounding of a distance, relative to it.
ROUNDING = 1e-9


def _centres(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean and count of the labelled rows per run, or of the candidates where none is."""
    size = vector_size(candidates, "features")
    given = mean_vectors(labelled, RUN, "features", size)
    alone = candidates.join(given, RUN, "left_anti")
    own = mean_vectors(alone, RUN, "features", size).withColumn("n", F.lit(0).cast("bigint"))
    return given.unionByName(own)


def _greedy(k: int):
    def pick(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "pmid"], ignore_index=True)
        features = np.stack(rows["features"].to_numpy())
        n, mean = int(centre["n"].iloc[0]), np.asarray(centre["mean"].iloc[0])
        steps = min(k, len(rows)) if n > 0 else 1
        free = np.ones(len(rows), dtype=bool)
        order = []
        for _ in range(steps):
            # Summed in order, as the passes do, so that near ties fall alike.
            gap = np.sqrt(np.cumsum((features - mean) ** 2, axis=1)[:, -1])
            gap[~free] = np.inf
            best = int(gap.argmin())
            free[best] = False
            order.append(best)
            n += 1
            mean = mean + (features[best] - mean) / n
        out = rows.loc[order, [*ROUND, "pmid"]]
        return out.assign(rank_in_round=np.arange(1, len(order) + 1))

    return pick


def pick_min_variance(
    candidates: DataFrame, labelled: DataFrame, k: int, batch_size: int = 0
) -> DataFrame:
    """``topic, policy, run, round, rank_in_round, pmid`` of k greedy picks per run.

    Candidates drawn in batches of a known ``batch_size`` are few enough for one task per
    run. A whole pool (``batch_size <= 0``) is measured once; the rows within ``reach`` are then
    worked on like a batch. Only a run with more than ``BATCH_IN_TASK`` of these is passed over k
    times, each pass a reduction in all tasks. A run without labelled rows gets the one row
    nearest to its pool's mean.
    """
    centres = _centres(candidates, labelled)
    rows = candidates.select(*ROUND, "pmid", "draw", "features")
    if 0 < batch_size <= BATCH_IN_TASK:
        return _in_tasks(rows, centres, k)
    centres = cut_lineage(centres)
    near = _near(rows, centres, k)
    short = near.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_rows"))
    long = cut_lineage(short.where(F.col("_rows") > BATCH_IN_TASK).select(*RUN))
    n_long = long.count()
    if n_long:
        near = near.join(F.broadcast(long), RUN, "left_anti")
    picked = _in_tasks(rows.join(broadcast_if_small(near), [*RUN, "pmid"], "left_semi"), centres, k)
    if n_long:
        long = F.broadcast(long)
        rest = _passes(rows.join(long, RUN, "left_semi"), centres.join(long, RUN, "left_semi"), k)
        picked = picked.unionByName(rest)
    return picked


def reach(nearest: Column, n: Column) -> Column:
    """How far from the first mean a pick can lie; ``nearest`` are the k smallest distances to it.

    Let the mean have moved by at most D before pick t. One of the t nearest rows is still free, so
    the pick lies within r_t + D of the mean as it is, hence within r_t + 2D of the first one; and
    it moves the mean by at most (r_t + D) / (n + t).
    """
    start = F.struct(F.lit(0.0).alias("moved"), F.lit(0.0).alias("reach"), F.lit(1).alias("t"))

    def step(a: Column, r: Column) -> Column:
        moved = a["moved"] + (r + a["moved"]) / (n + a["t"])
        far = F.greatest(a["reach"], r + 2 * a["moved"])
        return F.struct(moved.alias("moved"), far.alias("reach"), (a["t"] + 1).alias("t"))

    return F.aggregate(nearest, start, step)["reach"]


def _near(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``topic, policy, run, pmid`` of the rows that k picks can fall on, a written table."""
    far = distance(F.col("features"), F.col("mean")).alias("_dist")
    measured = cut_lineage(
        rows.join(broadcast_if_small(centres, WIDE_ROWS), RUN).select(*RUN, "pmid", "draw", "n", far)
    )
    few = first_k(measured, RUN, [F.col("_dist"), F.col("draw"), F.col("pmid")], k, "_place")
    # Without labelled rows there is one pick, the nearest row itself.
    nearest = F.array_sort(F.collect_list("_dist"))
    limits = few.groupBy(*RUN).agg(F.first("n").alias("_n"), nearest.alias("_r"))
    steps = F.when(F.col("_n") > 0, F.col("_r")).otherwise(F.slice("_r", 1, 1))
    limits = limits.select(*RUN, (reach(steps, F.col("_n")) * (1 + ROUNDING)).alias("_reach"))
    limits = broadcast_if_small(cut_lineage(limits))
    return cut_lineage(
        measured.join(limits, RUN).where(F.col("_dist") <= F.col("_reach")).select(*RUN, "pmid")
    )


def _in_tasks(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*ROUND, "pmid"])
    return (
        rows.groupBy(*RUN)
        .cogroup(fresh(centres).groupBy(*RUN))
        .applyInPandas(_greedy_or_none(k), f"{schema}, rank_in_round int")
        .select(*ROUND, "rank_in_round", "pmid")
    )


def _greedy_or_none(k: int):
    pick = _greedy(k)

    def checked(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or centre.empty:
            empty = rows[[*ROUND, "pmid"]].iloc[:0]
            return empty.assign(rank_in_round=pd.Series(dtype="int32"))
        return pick(rows, centre)

    return checked


def _passes(candidates: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    rows = cut_lineage(candidates.select(*ROUND, "pmid", "draw", "features"))
    centres = cut_lineage(centres)
    picked: DataFrame | None = None
    for step in range(1, k + 1):
        rest = rows
        if picked is not None:
            gone = broadcast_if_small(picked.select(*RUN, "pmid"))
            rest = rows.join(gone, [*RUN, "pmid"], "left_anti")
        # A row with its mean is wide; picks are ids. Both are counted before a broadcast.
        best = cut_lineage(nearest_to_mean(rest, broadcast_if_small(centres, WIDE_ROWS), RUN))
        now = cut_lineage(
            rows.join(broadcast_if_small(best), [*RUN, "pmid"], "left_semi")
            .withColumn("rank_in_round", F.lit(step))
        )
        picked = now if picked is None else picked.unionByName(now)
        moved = F.zip_with("mean", "features", lambda m, x: m + (x - m) / (F.col("n") + 1))
        # One column after the other: in one select the name in the lambda would mean the new n.
        centres = (
            centres.where(F.col("n") > 0)
            .join(now.select(*RUN, "features"), RUN)
            .withColumn("mean", moved)
            .withColumn("n", F.col("n") + 1)
            .select(*RUN, "n", "mean")
        )
    return picked.select(*ROUND, "rank_in_round", "pmid")
