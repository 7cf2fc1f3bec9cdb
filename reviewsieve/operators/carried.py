"""Smallest distances to the labelled articles, carried from round to round.

A state row is a pool article of a run with its smallest distance to the articles labelled up to
some round, its distance to the run's pivot (the first seed), and that round. A new round measures
an article only against what was labelled since. Articles of a run are cut into rings around the
pivot; a newly labelled article that lies farther from a ring than any smallest distance in it cannot
lower one (triangle inequality) and is not sent there, and inside a block the same test picks the
articles that are measured at all. Blocks meet blocks, so no pair of rows is ever emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.vectors import distance
from reviewsieve.operators.blocks import with_groups
from reviewsieve.operators.pool import ROUND, RUN
from reviewsieve.session import broadcast_if_small, cut_lineage, fresh

CANDIDATE_BLOCK = 4096
LABELLED_BLOCK = 1024
# Rings of a run; their borders are approximate quantiles of the distance to the pivot.
RINGS = 32
STATE = [*RUN, "pmid", "min_dist", "pivot_dist", "upto"]
# Rounding of a distance, relative to the distances it is compared with.
ROUNDING = 1e-9


def empty_state(candidates: DataFrame) -> DataFrame:
    """The state before the first round."""
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    own = ", ".join(f"{c} {types[c]}" for c in [*RUN, "pmid"])
    schema = f"{own}, min_dist double, pivot_dist double, upto int"
    return candidates.sparkSession.createDataFrame([], schema)


def _pivots(labelled: DataFrame) -> DataFrame:
    """The first labelled article of each run; its place in the log never changes."""
    first = F.min_by("features", F.struct("round", "rank_in_round", "pmid"))
    return labelled.groupBy(*RUN).agg(first.alias("pivot"))


def _cells(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")


def _lower(known: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """A block's smallest distances after a block of newly labelled articles."""
    out = known.drop(columns=["features", "_ring", "_cb", "_lb"])
    best = known["min_dist"].to_numpy().copy()
    if not new.empty:
        x = np.stack(known["features"].to_numpy())
        around, upto = known["pivot_dist"].to_numpy(), known["upto"].to_numpy()
        for y, far, since in new[["features", "pivot_dist", "round"]].itertuples(index=False):
            slack = ROUNDING * (around + far)
            may = np.flatnonzero((np.abs(around - far) < best + slack) & (upto < since))
            gap = x[may] - y
            found = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            best[may] = np.minimum(best[may], found)
    return out.assign(min_dist=best)


def carried_distances(
    candidates: DataFrame,
    labelled: DataFrame,
    state: DataFrame | None = None,
    candidate_block: int = CANDIDATE_BLOCK,
    labelled_block: int = LABELLED_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``(distances, state)`` of a round.

    ``candidates``: ``topic, policy, run, round, pmid, draw, features``; ``labelled``: ``topic,
    policy, run, round, rank_in_round, pmid, features``, all of them, a written table; ``state``:
    what the round before returned (``STATE`` columns), or None. ``distances`` is ``topic, policy, run, round,
    pmid, draw, min_dist`` of the candidates whose run has labelled articles. The new state
    replaces the old one: candidates up to the last labelled round, other articles as they were;
    articles that have been labelled since drop out.
    """
    state = empty_state(candidates) if state is None else state
    labelled = labelled.select(*RUN, "round", "rank_in_round", "pmid", "features")
    width = labelled.select(F.size("features").alias("w")).first()
    size = 8 * (width["w"] if width else 0)
    pivots = cut_lineage(_pivots(labelled))
    ends = labelled.groupBy(*RUN).agg(F.max("round").cast("int").alias("last"))

    to_pivot = distance(F.col("features"), F.col("pivot"))
    here = candidates.select(*ROUND, "pmid", "draw", "features").join(state, [*RUN, "pmid"], "left")
    here = with_groups(here, pivots, RUN, size)
    here = here.withColumns(
        {
            "pivot_dist": F.coalesce("pivot_dist", to_pivot),
            "min_dist": F.coalesce("min_dist", F.lit(float("inf"))),
            "upto": F.coalesce("upto", F.lit(-1)),
        }
    )
    # Distances are the narrow part of a row; the rings are drawn from these alone.
    narrow = here.drop("features", "pivot")
    levels = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    borders = cut_lineage(
        narrow.groupBy(*RUN).agg(F.percentile_approx("pivot_dist", levels).alias("_borders"))
    )
    ring = F.size(F.filter("_borders", lambda b: b < F.col("pivot_dist"))).alias("_ring")
    ringed = with_groups(here.drop("pivot"), borders, RUN, 8 * RINGS).select(*here.drop("pivot").columns, ring)
    rings = cut_lineage(
        ringed.groupBy(*RUN, "_ring").agg(
            F.min("pivot_dist").alias("_in"), F.max("pivot_dist").alias("_out"),
            F.max("min_dist").alias("_most"), F.min("upto").alias("_since"),
            _cells(F.count(F.lit(1)), candidate_block).alias("_cbs"),
        )
    )

    # A labelled article goes to the rings it may reach; there are RINGS of a run at most.
    new = with_groups(labelled, pivots, RUN, size).select(
        *RUN, "round", "pmid", "features", to_pivot.alias("pivot_dist")
    )
    slack = ROUNDING * (F.col("pivot_dist") + F.col("_out"))
    reaches = (
        (F.col("round") > F.col("_since"))
        & (F.col("pivot_dist") - F.col("_out") < F.col("_most") + slack)
        & (F.col("_in") - F.col("pivot_dist") < F.col("_most") + slack)
    )
    sent = with_groups(new, rings, RUN, 64).where(reaches)
    counts = sent.groupBy(*RUN, "_ring").agg(_cells(F.count(F.lit(1)), labelled_block).alias("_lbs"))
    grid = cut_lineage(rings.join(counts, [*RUN, "_ring"], "left").fillna(1, ["_lbs"]))
    grid = grid.select(*RUN, "_ring", "_cbs", "_lbs")

    own = lambda n: F.pmod(F.xxhash64("pmid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = [*RUN, "_ring", "_cb", "_lb"]
    left = with_groups(ringed, grid, [*RUN, "_ring"], 64).select(
        *ringed.columns, own("_cbs").alias("_cb"), every("_lbs").alias("_lb")
    )
    right = with_groups(sent.drop("_cbs"), fresh(grid), [*RUN, "_ring"], 64).select(
        *RUN, "_ring", "round", "features", "pivot_dist", every("_cbs").alias("_cb"), own("_lbs").alias("_lb")
    )
    kept = [*ROUND, "pmid", "draw", "min_dist", "pivot_dist", "upto"]
    types = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept)

    def lower(known: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if known.empty:
            return pd.DataFrame({c: [] for c in kept})
        return _lower(known, found)[kept]

    parts = left.groupBy(*cell).cogroup(fresh(right).groupBy(*cell)).applyInPandas(lower, schema)
    merged = parts.groupBy(*ROUND, "pmid", "draw").agg(
        F.min("min_dist").alias("min_dist"), F.first("pivot_dist").alias("pivot_dist")
    )
    measured = cut_lineage(with_groups(merged, ends, RUN, 16))
    done = measured.select(*RUN, "pmid", "min_dist", "pivot_dist", F.col("last").alias("upto"))
    others = state.join(fresh(done.select(*RUN, "pmid")), [*RUN, "pmid"], "left_anti")
    revealed = broadcast_if_small(fresh(labelled.select(*RUN, "pmid")))
    others = others.join(revealed, [*RUN, "pmid"], "left_anti")
    after = cut_lineage(others.select(*STATE).unionByName(done))
    return measured.select(*ROUND, "pmid", "draw", "min_dist"), after
