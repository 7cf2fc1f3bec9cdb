"""Reveal logs: what is labelled, what is left, what comes next.

A reveal log has one row per labelled article:
``topic, policy, run, round, rank_in_round, pmid, label``; seeds are round 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.hashing import draw
from reviewsieve.functions.ranking import first_k_drawn, sums_before
from reviewsieve.session import broadcast_if_small

RUN = ["topic", "policy", "run"]
ROUND = [*RUN, "round"]


def topic_counts(judged: DataFrame, topic: str = "topic") -> DataFrame:
    """Articles per topic: all, included (label 1) and excluded (label 0)."""
    return judged.groupBy(topic).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("label") == 1).alias("n_included"),
        F.count_if(F.col("label") == 0).alias("n_excluded"),
    )


def run_state(log: DataFrame, judged: DataFrame) -> DataFrame:
    """Where each run stands after its last round.

    ``found`` counts included articles revealed after the seeds; ``recall`` is null for a
    topic without any. ``done`` is set when the pool is empty or all are found; a topic with
    nothing to find goes on until its pool is empty.
    """
    totals = judged.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("label") == 1).alias("n_included")
    )
    revealed = log.groupBy(*RUN).agg(
        F.max("round").alias("last_round"),
        F.count(F.lit(1)).alias("n_labelled"),
        F.count_if((F.col("label") == 1) & (F.col("round") > 0)).alias("found"),
        F.count_if(F.col("label") == 1).alias("labelled_1"),
        F.count_if(F.col("label") == 0).alias("labelled_0"),
        F.count_if(~F.col("label").isin(0, 1)).alias("labelled_other"),
    )
    left = F.col("n_all") - F.col("n_labelled")
    recall = F.col("found") / F.nullif(F.col("n_included"), F.lit(0))
    return revealed.join(totals, "topic").select(
        *RUN, "last_round", "n_labelled", left.alias("n_pool"), "found", "n_included",
        "labelled_0", "labelled_1", "labelled_other",
        recall.alias("recall"),
        (
            (left == 0) | ((F.col("found") == F.col("n_included")) & (F.col("n_included") > 0))
        ).alias("done"),
    )


def pool(articles: DataFrame, log: DataFrame) -> DataFrame:
    """Articles not yet labelled, per run: ``topic, policy, run, pmid`` and what else is given.

    A log of checked size is broadcast, so the articles are filtered where they are.
    """
    runs = log.select(*RUN).distinct()
    seen = broadcast_if_small(log.select(*RUN, "pmid"))
    return articles.join(broadcast_if_small(runs), "topic").join(seen, [*RUN, "pmid"], "left_anti")


def candidates(
    pool_rows: DataFrame, batch_size: int, seed: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """A batch drawn without replacement from each pool; ``batch_size <= 0`` takes it all.

    ``pool_rows`` carries ``topic, policy, run, round``. The draw hangs on seed + run, round
    and id, not on the policy: all policies of a run meet the same first draws.
    """
    keys = keys or ROUND
    drawn = pool_rows.withColumn("_draw", draw(F.lit(seed) + F.col("run"), "round", "pmid"))
    if batch_size > 0:
        drawn = first_k_drawn(drawn, keys, "_draw", ["pmid"], batch_size, "place").drop("place")
    return drawn.withColumnRenamed("_draw", "draw")


def reveal(picks: DataFrame, judged: DataFrame) -> DataFrame:
    """Picks with their labels, ready to be appended to the log."""
    return picks.join(judged.select("topic", "pmid", "label"), ["topic", "pmid"]).select(
        *ROUND, "rank_in_round", "pmid", "label"
    )


def reveal_positions(log: DataFrame) -> DataFrame:
    """The log with ``pos``, the overall order of revealing within a run.

    Rows of earlier rounds are counted, not sorted: a run is never one window.
    """
    rounds = log.groupBy(*ROUND).agg(F.count(F.lit(1)).alias("_n"))
    before = sums_before(rounds, RUN, "round", {"_earlier": "_n"}).drop("_n")
    return log.join(before, ROUND).withColumn(
        "pos", F.col("_earlier") + F.col("rank_in_round")
    ).drop("_earlier")
