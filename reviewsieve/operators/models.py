"""Model steps of a round: fit, score, cluster, project; all runs or topics in one plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from reviewsieve.operators.clusters import cluster_runs
from reviewsieve.operators.logistic import PENALTY_C, fit_runs, score_runs
from reviewsieve.operators.policies import SCORED
from reviewsieve.operators.pool import RUN
from reviewsieve.operators.projection import project_topics

# How far the library's own fit of one run is driven.
TOLERANCE = 1e-8
MAX_STEPS = 500


def default_estimator(n_labelled: int) -> Estimator:
    """The model of ``score`` as a ``pyspark.ml`` estimator, for one run at a time."""
    return LogisticRegression(
        featuresCol="_x", labelCol="_y", family="binomial",
        regParam=1.0 / (PENALTY_C * n_labelled), elasticNetParam=0.0,
        standardization=False, tol=TOLERANCE, maxIter=MAX_STEPS,
    )


def fits(state) -> Column | bool:
    """Whether a run's labelled articles are of exactly two classes, 0 and 1.

    Takes a row of ``run_state``, or columns by name.
    """
    return (state["labelled_0"] > 0) & (state["labelled_1"] > 0) & (state["labelled_other"] == 0)


def rejected_runs(states: DataFrame) -> DataFrame:
    """Runs of score policies that cannot be fitted, with the reason, out of ``run_state``."""
    names = ("labelled_0", "labelled_1", "labelled_other")
    bad = states.where(F.col("policy").isin(*SCORED) & ~fits({n: F.col(n) for n in names}))
    return bad.select(*RUN, F.lit("labelled articles are not of classes 0 and 1").alias("reason"))


def score(
    labelled: DataFrame,
    candidates: DataFrame,
    estimator: Callable[[int], Estimator] | None = None,
    parallelism: int = 8,
) -> DataFrame:
    """Candidates with ``p``, the probability of label 1 under their own run's model.

    The model is fitted from scratch on all labelled rows of the run; runs whose labelled rows are
    not of two classes are left out (see ``rejected_runs``). Without an ``estimator`` it is a
    logistic regression with an L2 penalty (sum of losses + |w|^2 / (2C), C = 1), all runs in the
    same few jobs. ``estimator`` maps the number of labelled rows to any probabilistic
    ``pyspark.ml`` classifier on ``_x`` and ``_y``; these are fitted run by run, ``parallelism``
    at a time, so give ``labelled`` as a written table then.
    """
    if estimator is None:
        return score_runs(candidates, fit_runs(labelled, RUN), RUN)
    label = F.col("label")
    counts = labelled.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n_labelled"), F.count_if(label == 0).alias("labelled_0"),
        F.count_if(label == 1).alias("labelled_1"), F.count_if(~label.isin(0, 1)).alias("labelled_other"),
    )
    states = [s for s in counts.collect() if fits(s)]
    if not states:
        return candidates.withColumn("p", F.lit(0.0)).where(F.lit(False))
    train = labelled.select(
        *RUN, array_to_vector("features").alias("_x"), label.cast("double").alias("_y")
    )
    rows = candidates.withColumn("_x", array_to_vector("features"))

    def of_run(df: DataFrame, state: Row) -> DataFrame:
        same = [F.col(c) == F.lit(state[c]) for c in RUN]
        return df.where(reduce(lambda a, b: a & b, same))

    def fit(state: Row):
        return estimator(state.n_labelled).fit(of_run(train, state))

    with ThreadPool(max(1, min(parallelism, len(states)))) as threads:
        fitted = threads.map(fit, states)
    p = vector_to_array("probability")[1].alias("p")
    scored = [
        model.transform(of_run(rows, state)).select(*candidates.columns, p)
        for state, model in zip(states, fitted)
    ]
    return reduce(DataFrame.unionByName, scored)


def cluster(candidates: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``topic, policy, run, round, pmid, draw, cluster``: k-means of every run's candidates."""
    return cluster_runs(candidates, k, seed)


def project(features: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Articles as points ``x, y``: the first two principal components of their topic.

    ``keys`` names an article, ``by`` the topic among them (all but ``pmid``, if not given).
    """
    return project_topics(features, keys, [k for k in keys if k != "pmid"] if by is None else by)
