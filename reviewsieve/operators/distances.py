"""Smallest distance of each candidate to the labelled articles of its run.

Both sides are cut into blocks and every task holds one block of each. A task gives back
one number per candidate, its smallest distance within that pair of blocks; the smallest
of those is the result. No pair of rows is ever emitted and no side has to fit anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.operators.pool import ROUND, RUN
from reviewsieve.session import fresh

CANDIDATE_BLOCK = 4096
LABELLED_BLOCK = 1024


def _block_minimum(candidates: pd.DataFrame, labelled: pd.DataFrame) -> pd.DataFrame:
    left = np.stack(candidates["features"].to_numpy())
    right = np.stack(labelled["features"].to_numpy())
    best = np.full(len(left), np.inf)
    for row in right:
        gap = left - row
        np.minimum(best, np.einsum("ij,ij->i", gap, gap), out=best)
    out = candidates.drop(columns=["features", "_cb", "_lb"])
    return out.assign(min_dist=np.sqrt(best))


def min_distances(
    candidates: DataFrame,
    labelled: DataFrame,
    candidate_block: int = CANDIDATE_BLOCK,
    labelled_block: int = LABELLED_BLOCK,
) -> DataFrame:
    """``topic, policy, run, round, pmid, draw, min_dist`` for candidates with features.

    ``labelled`` carries ``topic, policy, run, pmid, features``. With ``min_dist`` already
    known from earlier rounds (a column of the candidates), pass only the newly labelled.
    """
    known = "min_dist" in candidates.columns
    blocks = lambda n, size: F.ceil(n / F.lit(size))
    cand_blocks = candidates.groupBy(*RUN).agg(
        blocks(F.count(F.lit(1)), candidate_block).alias("_cbs")
    )
    lab_blocks = labelled.groupBy(*RUN).agg(
        blocks(F.count(F.lit(1)), labelled_block).alias("_lbs")
    )
    grid = cand_blocks.join(lab_blocks, RUN)
    own = lambda n: F.pmod(F.xxhash64("pmid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = candidates.join(grid, RUN).select(
        *ROUND, "pmid", "draw", "features", own("_cbs").alias("_cb"), every("_lbs").alias("_lb")
    )
    right = labelled.join(grid, RUN).select(
        *RUN, "features", every("_cbs").alias("_cb"), own("_lbs").alias("_lb")
    )
    right = fresh(right)
    pmid_type = candidates.schema["pmid"].dataType.simpleString()
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ROUND)
    cell = [*RUN, "_cb", "_lb"]
    parts = (
        left.groupBy(*cell)
        .cogroup(right.groupBy(*cell))
        .applyInPandas(
            _cell_minimum, f"{schema}, pmid {pmid_type}, draw string, min_dist double"
        )
    )
    if known:
        parts = parts.unionByName(candidates.select(*ROUND, "pmid", "draw", "min_dist"))
    return parts.groupBy(*ROUND, "pmid", "draw").agg(F.min("min_dist").alias("min_dist"))


def _cell_minimum(candidates: pd.DataFrame, labelled: pd.DataFrame) -> pd.DataFrame:
    if candidates.empty or labelled.empty:
        columns = [*ROUND, "pmid", "draw"]
        return candidates[columns].iloc[:0].assign(min_dist=pd.Series(dtype="float64"))
    return _block_minimum(candidates, labelled)
