"""Carried distances against all distances, and rounds with and without what is carried."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.operators import carried, policies, pool, seeds, variance
from reviewsieve.operators.distances import min_distances
from reviewsieve.plans.acquire import acquire_round, next_round, start_log
from reviewsieve.session import cut_lineage


def items(spark, n=160, dim=3, spread=1.0):
    rng = np.random.default_rng(3)
    rows = []
    for topic in ("T", "U"):
        for i in range(n):
            x = rng.normal(5 * (i % 4), spread, dim).round(3)
            rows.append((topic, i, x.tolist(), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "topic string, pmid long, features array<double>, label int")


def a_log(rows, rounds):
    """Ten seeds, then ten more articles a round, in the order of ids."""
    at = F.floor(F.col("pmid") / 10).cast("int")
    return rows.where(at <= rounds).select(
        "topic", F.lit("diversity").alias("policy"), F.lit(0).alias("run"), at.alias("round"),
        (F.col("pmid") % 10 + 1).cast("int").alias("rank_in_round"), "pmid", "label",
    )


def sides(rows, log, batch):
    here = pool.pool(rows.select("topic", "pmid", "features"), log)
    last = log.agg(F.max("round")).first()[0]
    drawn = pool.candidates(here.withColumn("round", F.lit(last + 1)), batch, seed=last)
    return cut_lineage(drawn), log.join(rows.select("topic", "pmid", "features"), ["topic", "pmid"])


@pytest.mark.parametrize("batch", [0, 40])
@pytest.mark.parametrize("cells", [(4096, 1024), (16, 4)])
def test_carried_distances_equal_all_distances(spark, monkeypatch, batch, cells):
    measured = []
    lower = carried._lower
    monkeypatch.setattr(carried, "_lower", lambda a, b: (measured.append(len(b)), lower(a, b))[1])
    rows, state = items(spark), None
    for rounds in range(4):
        log = cut_lineage(a_log(rows, rounds))
        drawn, labelled = sides(rows, log, batch)
        got, state = carried.carried_distances(drawn, labelled, state, *cells)
        key = lambda r: (r.topic, r.pmid)
        want = {key(r): r.min_dist for r in min_distances(drawn, labelled).collect()}
        assert {key(r): r.min_dist for r in got.collect()} == pytest.approx(want, abs=1e-12)
        kept = state.collect()
        assert len({key(r) for r in kept}) == len(kept)
        if batch == 0:
            assert {r.upto for r in kept} == {rounds} and len(kept) == len(want)


def test_far_articles_are_not_sent(spark):
    """Two heaps far apart: once both are known, an article of one cannot lower the other."""
    rows = [("T", i, [1000.0 * (i % 2), float(i)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "topic string, pmid long, features array<double>, label int")
    sent = []

    def spy(known, new):
        sent.append((set(known["features"].map(lambda x: x[0])), set(new["features"].map(lambda x: x[0]))))
        return known

    drawn, labelled = sides(df, cut_lineage(a_log(df, 0)), 0)
    _, state = carried.carried_distances(drawn, labelled)
    more = cut_lineage(a_log(df, 1).where("round = 0 or pmid = 11"))
    drawn, labelled = sides(df, more, 0)
    # Rows that any labelled article of round 1 is sent to lie in its own heap.
    got, after = carried.carried_distances(drawn, labelled, state)
    want = {r.pmid: r.min_dist for r in min_distances(drawn, labelled).collect()}
    assert {r.pmid: r.min_dist for r in got.collect()} == pytest.approx(want)


def test_rows_without_labelled_articles_and_empty_pools(spark):
    rows = items(spark, 30)
    log = cut_lineage(a_log(rows.where("topic = 'T'"), 0))
    drawn = rows.select(
        "topic", F.lit("diversity").alias("policy"), F.lit(0).alias("run"), F.lit(1).alias("round"), "pmid",
        F.lit("d").alias("draw"), "features",
    )
    labelled = log.join(rows.select("topic", "pmid", "features"), ["topic", "pmid"])
    got, state = carried.carried_distances(drawn, labelled)
    assert {r.topic for r in got.collect()} == {"T"} == {r.topic for r in state.collect()}
    got, state = carried.carried_distances(drawn.where("false"), labelled, state)
    assert got.count() == 0 and {r.pmid for r in state.collect()} == set(range(10, 30))


@pytest.mark.parametrize("batch", [0, 25])
def test_three_rounds_with_and_without_state(spark, batch):
    rows = items(spark, 60)
    features, judged = rows.select("topic", "pmid", "features"), rows.select("topic", "pmid", "label")
    log = cut_lineage(start_log(seeds.start_pool(rows, 6), ["diversity", "random"]))
    distances = None
    for seed in (1, 2, 3):
        step = next_round(features, judged, log, batch, 5, seed, distances=distances)
        plain = acquire_round(features, judged, log, batch, 5, seed)
        picks = sorted(map(tuple, step.picks.collect()))
        assert picks == sorted(map(tuple, plain.collect())) and len(picks) == 20
        log, distances = cut_lineage(log.unionByName(step.picks)), step.distances


def min_variance_sides(spark, spread):
    rows = items(spark, 120, spread=spread)
    log = cut_lineage(a_log(rows, 1).withColumn("policy", F.lit("minimum_variance")))
    return sides(rows, log, 0)


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_short_lists_of_minimum_variance(spark, monkeypatch, spread):
    """Whole pools by short list and by passes pick like one task; ``spread`` 0 is all ties."""
    drawn, labelled = min_variance_sides(spark, spread)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(variance.pick_min_variance(drawn, labelled, 6, batch_size=1000))
    assert rows(variance.pick_min_variance(drawn, labelled, 6)) == want and len(want) == 12
    near = variance._near(drawn, cut_lineage(variance._centres(drawn, labelled)), 6)
    if spread:
        assert near.count() < 0.7 * drawn.count()
    monkeypatch.setattr(variance, "BATCH_IN_TASK", 10)
    assert rows(variance.pick_min_variance(drawn, labelled, 6)) == want
    assert policies.POLICIES[-1] == "minimum_variance"
