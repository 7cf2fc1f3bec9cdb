"""Acquisition policies: which candidates of a round to reveal next.

Candidates carry ``topic, policy, run, round, pmid, draw``; score policies also ``p``, the
probability of inclusion, and the adaptive one ``recall``. One plan serves all topics,
policies and runs. Ties are broken by draw, then id. Picks come back with
``rank_in_round``, the order in which they are revealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import first_k
from reviewsieve.functions.vectors import distance
from reviewsieve.operators.pool import ROUND

# The policies and their names, and the default switch of the adaptive one.
# "uncertainty" takes the largest margins and "certainty" the smallest, as named there.
POLICIES = (
    "uncertainty",
    "certainty",
    "random",
    "alternating",
    "diversity",
    "adaptive_certainty_uncertainty",
    "clustering",
    "minimum_variance",
)
ADAPTIVE_THRESHOLD = 0.8
# Plain names for the two margin policies.
ALIASES = {"margin_high": "uncertainty", "margin_low": "certainty"}
SCORED = ("uncertainty", "certainty", "alternating", "adaptive_certainty_uncertainty")


def check_parameters(policy: str, batch_size: int, reveal_size: int) -> str:
    """The policy's own name; raises on unknown policies and impossible sizes."""
    name = ALIASES.get(policy, policy)
    if name not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, choose from {', '.join(POLICIES)}")
    if reveal_size < 1:
        raise ValueError("reveal_size must be at least 1")
    if 0 < batch_size < reveal_size:
        raise ValueError("reveal_size cannot be greater than batch_size")
    return name


def margin(p: Column | str) -> Column:
    """Distance of the two class probabilities."""
    p = F.col(p) if isinstance(p, str) else p
    return F.abs(2 * p - 1)


def takes_largest(threshold: float = ADAPTIVE_THRESHOLD) -> Column:
    """Whether this row's policy wants large margins in this round.

    Alternating starts with them in round 1. Adaptive wants small ones until recall
    reaches the threshold, and for good if the topic has nothing to find.
    """
    policy = F.col("policy")
    return (
        F.when(policy == "uncertainty", True)
        .when(policy == "certainty", False)
        .when(policy == "alternating", F.col("round") % 2 == 1)
        .when(
            policy == "adaptive_certainty_uncertainty",
            F.coalesce(F.col("recall") >= threshold, F.lit(False)),
        )
    )


def _revealed(picked: DataFrame, by: str) -> DataFrame:
    """Picks numbered by rising ``by``; there are at most reveal-size rows per window."""
    order = Window.partitionBy(*ROUND).orderBy(by, "draw", "pmid")
    return picked.select(
        *ROUND, F.row_number().over(order).alias("rank_in_round"), "pmid"
    )


def pick_by_margin(
    scored: DataFrame, k: int, threshold: float = ADAPTIVE_THRESHOLD
) -> DataFrame:
    """Picks of the four score policies, the largest or the smallest margins."""
    if "recall" not in scored.columns:
        scored = scored.withColumn("recall", F.lit(None).cast("double"))
    ranked = scored.withColumn("_margin", margin("p")).withColumn(
        "_key", F.when(takes_largest(threshold), -F.col("_margin")).otherwise(F.col("_margin"))
    )
    few = first_k(
        ranked.select(*ROUND, "pmid", "draw", "_margin", "_key"),
        ROUND, [F.col("_key"), F.col("draw"), F.col("pmid")], k, "_place",
    )
    return _revealed(few, "_margin")


def pick_random(drawn: DataFrame, k: int) -> DataFrame:
    few = first_k(
        drawn.select(*ROUND, "pmid", "draw"),
        ROUND, [F.col("draw"), F.col("pmid")], k, "rank_in_round",
    )
    return few.select(*ROUND, "rank_in_round", "pmid")


def pick_farthest(distances: DataFrame, k: int) -> DataFrame:
    """Diversity: the candidates farthest from all labelled ones, by ``min_dist``."""
    few = first_k(
        distances.select(*ROUND, "pmid", "draw", "min_dist"),
        ROUND, [F.desc("min_dist"), F.col("draw"), F.col("pmid")], k, "_place",
    )
    return _revealed(few, "min_dist")


def pick_per_cluster(clustered: DataFrame) -> DataFrame:
    """Clustering: one drawn candidate of each cluster, in cluster order."""
    few = first_k(
        clustered.select(*ROUND, "pmid", "draw", "cluster"),
        [*ROUND, "cluster"], [F.col("draw"), F.col("pmid")], 1, "_place",
    )
    return _revealed(few, "cluster")


def nearest_to_mean(rows: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the row nearest to the group's mean: ``(keys, pmid)``.

    ``means`` has one row per group. Each task keeps its own nearest row per group, so the
    vectors are not shuffled.
    """
    measured = rows.join(means.select(*keys, "mean"), keys).select(
        *keys, "pmid", "draw", distance(F.col("features"), F.col("mean")).alias("_dist")
    )
    return first_k(
        measured, keys, [F.col("_dist"), F.col("draw"), F.col("pmid")], 1, "_place"
    ).select(*keys, "pmid")
