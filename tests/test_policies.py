import hashlib

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from reviewsieve.operators import distances, models, policies, pool, seeds, variance
from reviewsieve.plans.acquire import acquire_round, start_log
from reviewsieve.session import cut_lineage

DIM = 4


def features(spark, n=90, topic="T"):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        label = int(i % 6 == 0)
        rows.append((topic, i, [float(v) for v in rng.normal(label, 1, DIM)], label))
    return spark.createDataFrame(rows, "topic string, pmid long, features array<double>, label int")


def round_rows(spark, rows):
    schema = "topic string, policy string, run int, round int, pmid long, draw string, p double, recall double"
    return spark.createDataFrame(rows, schema)


def picked(df):
    return [r.pmid for r in df.orderBy("rank_in_round").collect()]


def candidates_of(spark, policy, round_=1, recall=None):
    ps = [0.5, 0.1, 0.95, 0.3, 0.52, 0.5, 0.05]
    return round_rows(
        spark, [("T", policy, 0, round_, i, f"{9 - i}", p, recall) for i, p in enumerate(ps)]
    )


@pytest.mark.parametrize(
    "policy,round_,recall,want",
    [
        ("uncertainty", 1, None, [1, 6, 2]),
        ("certainty", 1, None, [5, 0, 4]),
        ("alternating", 1, None, [1, 6, 2]),
        ("alternating", 2, None, [5, 0, 4]),
        ("adaptive_certainty_uncertainty", 3, 0.79, [5, 0, 4]),
        ("adaptive_certainty_uncertainty", 3, 0.8, [1, 6, 2]),
        ("adaptive_certainty_uncertainty", 3, None, [5, 0, 4]),
    ],
)
def test_margin_policies(spark, policy, round_, recall, want):
    got = picked(policies.pick_by_margin(candidates_of(spark, policy, round_, recall), 3))
    # Margins 0.9 (id 2) and 0.9 (id 6) are equal up to rounding; both are taken.
    assert set(got) == set(want) and got[0] == want[0]


def test_picks_beyond_the_pool_are_the_pool(spark):
    assert len(picked(policies.pick_by_margin(candidates_of(spark, "certainty"), 50))) == 7
    assert picked(policies.pick_random(candidates_of(spark, "random"), 2)) == [6, 5]


def test_parameter_checks():
    assert policies.check_parameters("margin_low", 10, 5) == "certainty"
    assert policies.check_parameters("random", 0, 500) == "random"
    with pytest.raises(ValueError, match="unknown policy"):
        policies.check_parameters("best", 10, 5)
    with pytest.raises(ValueError, match="greater"):
        policies.check_parameters("random", 4, 5)


def pool_and_labelled(spark, policy):
    rows = features(spark)
    first = rows.where("pmid < 12").select(
        "topic", F.lit(policy).alias("policy"), F.lit(0).alias("run"), F.lit(0).alias("round"),
        F.col("pmid").cast("int").alias("rank_in_round"), "pmid", "label",
    )
    here = pool.pool(rows.select("topic", "pmid", "features"), first).withColumn("round", F.lit(1))
    drawn = pool.candidates(here, 0)
    labelled = first.select(*pool.RUN, "pmid", "label").join(
        rows.select("topic", "pmid", "features"), ["topic", "pmid"]
    )
    return drawn, labelled


def arrays(df):
    return {r.pmid: np.array(r.features) for r in df.collect()}


def test_min_distances_in_many_blocks(spark):
    drawn, labelled = pool_and_labelled(spark, "diversity")
    known = arrays(labelled)
    want = {
        pmid: min(np.linalg.norm(x - v) for v in known.values()) for pmid, x in arrays(drawn).items()
    }
    for blocks in ((4096, 1024), (7, 3)):
        got = {r.pmid: r.min_dist for r in distances.min_distances(drawn, labelled, *blocks).collect()}
        assert got == pytest.approx(want)
    # Carried distances: first half of the labelled, then the other half on top.
    part = distances.min_distances(drawn, labelled.where("pmid < 6"))
    carried = drawn.join(part.select("pmid", "min_dist"), "pmid")
    both = distances.min_distances(carried, labelled.where("pmid >= 6"))
    assert {r.pmid: r.min_dist for r in both.collect()} == pytest.approx(want)
    far = sorted(want, key=want.get)[-5:]
    assert picked(policies.pick_farthest(distances.min_distances(drawn, labelled), 5)) == far


def greedy_by_variance(known, pool_rows, k):
    """The definition itself: try every row, keep the one with the smallest total variance."""
    known, left, order = list(known.values()), dict(pool_rows), []
    for _ in range(k):
        rise = {p: np.var(np.vstack([*known, x]), axis=0).sum() for p, x in left.items()}
        best = min(rise, key=rise.get)
        order.append(best)
        known.append(left.pop(best))
    return order


@pytest.mark.parametrize("batch_size", [0, 100])
def test_min_variance_equals_its_definition(spark, batch_size):
    drawn, labelled = pool_and_labelled(spark, "minimum_variance")
    want = greedy_by_variance(arrays(labelled), arrays(drawn), 4)
    assert picked(variance.pick_min_variance(drawn, labelled, 4, batch_size)) == want


@pytest.mark.parametrize("batch_size", [0, 100])
def test_min_variance_without_labelled_rows(spark, batch_size):
    drawn, labelled = pool_and_labelled(spark, "minimum_variance")
    rows = arrays(drawn)
    centre = np.mean(list(rows.values()), axis=0)
    want = min(rows, key=lambda p: np.linalg.norm(rows[p] - centre))
    got = variance.pick_min_variance(drawn, labelled.where("false"), 3, batch_size)
    assert picked(got) == [want]


def test_fit_meets_the_optimality_condition(spark):
    drawn, labelled = pool_and_labelled(spark, "certainty")
    scored = models.score(labelled, drawn)
    p = {r.pmid: r.p for r in scored.collect()}
    rows = labelled.collect()
    x = np.array([r.features for r in rows])
    y = np.array([r.label for r in rows], dtype=float)
    design = np.c_[x, np.ones(len(y))]
    penalty = np.diag([1.0] * DIM + [0.0])
    w = np.zeros(DIM + 1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (q - y) + penalty @ w
        w -= np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + penalty, gradient)
    want = {k: 1 / (1 + np.exp(-(np.r_[v, 1.0] @ w))) for k, v in arrays(drawn).items()}
    assert p == pytest.approx(want, abs=1e-9)
    one_by_one = models.score(cut_lineage(labelled), drawn, models.default_estimator).collect()
    assert {r.pmid: r.p for r in one_by_one} == pytest.approx(p, abs=1e-6)


def test_other_estimators_and_single_class(spark):
    drawn, labelled = pool_and_labelled(spark, "certainty")
    trees = lambda n: GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=2)
    assert models.score(cut_lineage(labelled), drawn, trees).where("p between 0 and 1").count() == 78
    one = labelled.where("label = 0")
    assert models.score(one, drawn).count() == models.score(one, drawn, trees).count() == 0


def test_a_run_of_one_class_does_not_stop_the_others(spark):
    rows = [(t, i, [float(i % 5), float(i % 3)], int(i % 4 == 0)) for t in ("good", "bad") for i in range(40)]
    judged = spark.createDataFrame(rows, "topic string, pmid long, features array<double>, label int")
    seeds = judged.where("pmid < 8 and (topic = 'good' or label = 0)").withColumn("rank_in_round", F.lit(1))
    log = cut_lineage(start_log(seeds, ["uncertainty"]))
    picks = acquire_round(judged.select("topic", "pmid", "features"), judged, log, 20, 5)
    assert [tuple(r) for r in picks.groupBy("topic").count().collect()] == [("good", 5)]
    rejects = models.rejected_runs(pool.run_state(log, judged)).collect()
    assert [(r.topic, r.policy, r.run) for r in rejects] == [("bad", "uncertainty", 0)]


def test_topics_with_nothing_to_find_go_on_and_unjudged_articles_stay_out(spark):
    rows = [("t", i, [float(i), 1.0], 0) for i in range(20)]
    judged = spark.createDataFrame(rows, "topic string, pmid long, features array<double>, label int")
    more = spark.createDataFrame([("t", 100 + i, [float(i), 2.0], 0) for i in range(50)], judged.schema)
    log = cut_lineage(start_log(judged.where("pmid < 4").withColumn("rank_in_round", F.lit(1)), ["random"]))
    features = judged.unionByName(more).select("topic", "pmid", "features")
    picks = acquire_round(features, judged, log, 0, 7).collect()
    assert len(picks) == 7 and all(r.pmid < 20 for r in picks)


def test_clustering_picks_one_per_cluster(spark):
    drawn, labelled = pool_and_labelled(spark, "clustering")
    clustered = cut_lineage(models.cluster(drawn, 6))
    picks = policies.pick_per_cluster(clustered)
    chosen = picks.join(clustered, "pmid").select("cluster").collect()
    assert sorted(r.cluster for r in chosen) == list(range(len(chosen))) and 1 < len(chosen) <= 6


def test_three_rounds_of_all_policies(spark):
    rows = features(spark).unionByName(features(spark, 40, "U"))
    judged = rows.select("topic", "pmid", "label")
    given = rows.select("topic", "pmid", "features")
    log = cut_lineage(start_log(seeds.start_pool(rows, 6), list(policies.POLICIES)))
    for step in (1, 2, 3):
        picks = cut_lineage(acquire_round(given, judged, log, batch_size=20, reveal_size=5, seed=step))
        assert {r.round for r in picks.select("round").distinct().collect()} == {step}
        assert picks.join(log, [*pool.RUN, "pmid"], "left_semi").count() == 0
        sizes = picks.groupBy(*pool.RUN).agg(
            F.count("*").alias("n"), F.max("rank_in_round").alias("last"), F.countDistinct("pmid").alias("ids")
        ).collect()
        assert len(sizes) == 16
        assert all(s.n == s.last == s.ids for s in sizes)
        assert all(s.n == 5 for s in sizes if s.policy != "clustering")
        log = cut_lineage(log.unionByName(picks))
    positions = pool.reveal_positions(log).where("topic = 'T' and policy = 'random'")
    assert sorted(r.pos for r in positions.collect()) == list(range(1, 22))


def test_a_finished_run_gets_no_round(spark):
    rows = features(spark, 7)
    judged = rows.select("topic", "pmid", "label")
    log = cut_lineage(start_log(seeds.start_pool(rows, 5), ["random"]))
    last = cut_lineage(acquire_round(rows, judged, log, 0, 50))
    assert last.count() == 2
    assert acquire_round(rows, judged, log.unionByName(last), 0, 50).count() == 0


def test_policies_of_a_run_share_their_draws(spark):
    rows = features(spark)
    log = start_log(seeds.start_pool(rows, 4), ["random", "certainty"])
    here = pool.pool(rows.select("topic", "pmid"), log).withColumn("round", F.lit(1))
    got = {}
    for r in pool.candidates(here, 10, seed=4).collect():
        got.setdefault(r.policy, set()).add(r.pmid)
    assert got["random"] == got["certainty"] and len(got["random"]) == 10
    digest = lambda i: hashlib.md5(f"4|1|{i}".encode()).hexdigest()
    seeded = {r.pmid for r in log.collect()}
    assert got["random"] == set(sorted(set(range(90)) - seeded, key=digest)[:10])


def test_both_forms_of_minimum_variance_pick_alike(spark):
    drawn, labelled = pool_and_labelled(spark, "minimum_variance")
    one = variance.pick_min_variance(drawn, labelled, 4, batch_size=50)
    other = variance.pick_min_variance(drawn, labelled, 4)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(one) == rows(other) and one.count() > 0
