"""One acquisition round for many topics, policies and runs at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.operators import models, policies, pool
from reviewsieve.operators.carried import carried_distances
from reviewsieve.operators.distances import min_distances
from reviewsieve.operators.pool import ROUND, RUN
from reviewsieve.operators.variance import pick_min_variance
from reviewsieve.session import broadcast_if_small, cut_lineage


def start_log(seeds: DataFrame, run_policies: list[str], run: int = 0) -> DataFrame:
    """Round 0 of a reveal log: the same seeds for each policy of a run.

    ``seeds`` carries ``topic, rank_in_round, pmid, label``.
    """
    names = [policies.ALIASES.get(name, name) for name in run_policies]
    each = F.explode(F.array(*[F.lit(name) for name in names])).alias("policy")
    return seeds.select(
        "topic", each, F.lit(run).alias("run"), F.lit(0).alias("round"),
        "rank_in_round", "pmid", "label",
    )


class Round(NamedTuple):
    """The next round's rows, and the distances to hand to the round after it."""

    picks: DataFrame
    distances: DataFrame | None


def acquire_round(features: DataFrame, judged: DataFrame, log: DataFrame, *args, **options) -> DataFrame:
    """The picks of ``next_round``, for callers that carry nothing from round to round."""
    return next_round(features, judged, log, *args, carry=False, **options).picks


def next_round(
    features: DataFrame,
    judged: DataFrame,
    log: DataFrame,
    batch_size: int = 10,
    reveal_size: int = 1,
    seed: int = 0,
    threshold: float = policies.ADAPTIVE_THRESHOLD,
    estimator=None,
    distances: DataFrame | None = None,
    carry: bool = True,
) -> Round:
    """The next round's rows of every run in ``log`` that is not done.

    ``features``: ``topic, pmid, features``; ``judged``: ``topic, pmid, label``. The caller
    appends the picks to the log and calls again. Articles without a judgement stay out of
    the pool; runs that cannot be fitted get no rows (``models.rejected_runs`` lists them).
    ``distances`` is what the round before returned; with it the diversity policy measures its
    candidates only against the articles labelled since, without it against all of them. The
    picks are the same. ``carry`` False returns no distances and spares keeping them. Models are
    fitted for score policies only.
    """
    states = cut_lineage(pool.run_state(log, judged).where(~F.col("done")))
    names = [row.policy for row in states.select("policy").distinct().collect()]
    if not names:
        return Round(log.where(F.lit(False)), distances)
    for name in names:
        policies.check_parameters(name, batch_size, reveal_size)
    open_runs = states.select(*RUN, (F.col("last_round") + 1).cast("int").alias("round"), "recall")

    # Only judged articles can be revealed, so only those are drawn.
    known = judged.select("topic", "pmid").dropDuplicates()
    articles = features.select("topic", "pmid").join(known, ["topic", "pmid"], "left_semi")
    here = pool.pool(articles, log).join(broadcast_if_small(open_runs), RUN)
    drawn = pool.candidates(here, batch_size, seed)
    if batch_size > 0:
        drawn = broadcast_if_small(cut_lineage(drawn))
    rows = cut_lineage(features.join(drawn, ["topic", "pmid"]))
    revealed = log.select(*RUN, "round", "rank_in_round", "pmid", "label")
    labelled = cut_lineage(features.join(broadcast_if_small(revealed), ["topic", "pmid"]))

    def only(*wanted: str) -> tuple[DataFrame, DataFrame] | None:
        if not set(wanted) & set(names):
            return None
        mine = F.col("policy").isin(*wanted)
        return rows.where(mine), labelled.where(mine)

    picks = []
    if given := only(*policies.SCORED):
        scored = models.score(given[1], given[0], estimator)
        picks.append(policies.pick_by_margin(scored, reveal_size, threshold))
    if given := only("random"):
        picks.append(policies.pick_random(given[0], reveal_size))
    if given := only("diversity"):
        if carry:
            measured, distances = carried_distances(*given, distances)
        else:
            measured = min_distances(*given)
        picks.append(policies.pick_farthest(measured, reveal_size))
    if given := only("clustering"):
        picks.append(policies.pick_per_cluster(models.cluster(given[0], reveal_size, seed)))
    if given := only("minimum_variance"):
        picks.append(pick_min_variance(*given, reveal_size, batch_size))
    chosen = reduce(DataFrame.unionByName, [p.select(*ROUND, "rank_in_round", "pmid") for p in picks])
    return Round(pool.reveal(chosen, judged).select(*log.columns), distances)
