"""Tables behind a picture of the review: projected points and what is labelled when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import sums_before
from reviewsieve.operators.pool import RUN


def frame_points(projection: DataFrame, log: DataFrame) -> DataFrame:
    """The labelled points of every run with ``from_round``, the round that labelled them.

    A frame's labelled points are those with ``from_round <= frame`` (see ``frame``), so
    frames are read off one row per point and never multiplied out. The background of a
    picture is the projection itself, once per topic and not once per run.
    """
    seen = log.select(*RUN, "pmid", F.col("round").alias("from_round"), "label")
    return seen.join(projection, ["topic", "pmid"]).select(
        *RUN, "pmid", "x", "y", "label", "from_round"
    )


def frame(points: DataFrame, round_: int) -> DataFrame:
    """Labelled points as they stood after one round."""
    return points.where(F.col("from_round") <= round_)


def frame_sizes(log: DataFrame) -> DataFrame:
    """Labelled articles per frame: ``topic, policy, run, round, labelled``."""
    rounds = log.groupBy(*RUN, "round").agg(F.count(F.lit(1)).alias("revealed"))
    sums = sums_before(rounds, RUN, "round", {"_before": "revealed"})
    return sums.select(
        *RUN, "round", (F.col("_before") + F.col("revealed")).alias("labelled")
    )
