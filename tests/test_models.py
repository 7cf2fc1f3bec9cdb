"""Fits, clusters and projections of many runs or topics in one plan, small and large ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.operators import blocks, clusters, logistic, projection
from reviewsieve.operators.pool import ROUND, RUN

ROW = "topic string, policy string, run int, round int, pmid long, draw string, features array<double>, label int"


def runs(spark, sizes, dim=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for run, n in enumerate(sizes):
        for i in range(n):
            label = int(rng.random() < 0.4)
            x = rng.normal(0.7 * label + 0.1 * run, 1, dim)
            rows.append(("T", "certainty", run, 1, i, f"{(i * 7919) % 100_003:06d}", x.tolist(), label))
    return spark.createDataFrame(rows, ROW)


def by_run(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.run, []).append(r)
    return out


def plain_fit(rows, c=1.0):
    x = np.c_[np.array([r.features for r in rows]), np.ones(len(rows))]
    y = np.array([r.label for r in rows], float)
    penalty = np.diag([1 / c] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_fits_equal_single_fits(spark, block_rows):
    rows = runs(spark, [12, 60, 200])
    fitted = logistic.fit_runs(rows, RUN, block_rows=block_rows)
    found = by_run(fitted)
    for run, own in by_run(rows).items():
        assert np.allclose(found[run][0].coefficients, plain_fit(own), atol=1e-8)
        assert found[run][0].gradient < 1e-6 and found[run][0].steps < 20
    p = {(r.run, r.pmid): r.p for r in logistic.score_runs(rows, fitted, RUN).collect()}
    for run, own in by_run(rows).items():
        w = plain_fit(own)
        want = {(run, r.pmid): 1 / (1 + np.exp(-(np.r_[r.features, 1] @ w))) for r in own}
        assert {k: v for k, v in p.items() if k[0] == run} == pytest.approx(want, abs=1e-9)


def test_more_features_than_rows_and_rows_that_can_be_parted(spark):
    rows = runs(spark, [8], dim=30)
    (own,) = by_run(rows).values()
    assert np.allclose(logistic.fit_runs(rows, RUN).first().coefficients, plain_fit(own), atol=1e-8)
    wide = [("T", "p", 0, 1, i, "", [1000.0 * (i % 2), 1.0], i % 2) for i in range(40)]
    for block_rows in (2048, 8):
        row = logistic.fit_runs(spark.createDataFrame(wide, ROW), RUN, block_rows=block_rows).first()
        assert row.gradient < 1e-6 and row.steps < logistic.MAX_STEPS


def test_runs_that_cannot_be_fitted_are_left_out(spark):
    rows = runs(spark, [20, 20, 20, 20])
    label = F.when(F.col("run") == 0, 1).when((F.col("run") == 1) & (F.col("pmid") == 3), 2).otherwise(F.col("label"))
    label = F.when((F.col("run") == 2) & (F.col("pmid") == 3), None).otherwise(label)
    fitted = logistic.fit_runs(rows.withColumn("label", label), RUN)
    assert [r.run for r in fitted.collect()] == [3]
    none = logistic.fit_runs(rows.where("false"), RUN)
    assert none.count() == 0 and logistic.score_runs(rows, none, RUN).count() == 0


def plain_clusters(rows, k, seed=0):
    """The rule itself on the rows of one run in memory."""
    from hashlib import md5

    rows = sorted(rows, key=lambda r: (r.draw, r.pmid))
    x = np.array([r.features for r in rows])
    gaps = lambda c: ((x[:, None] - c[None]) ** 2).sum(-1)
    taken = [0]
    for i in range(clusters.SEED_ROUNDS):
        gap = gaps(x[taken]).min(1)
        for j, r in enumerate(rows):
            u = int(md5(f"{seed}|{i}|{r.draw}".encode()).hexdigest()[:8], 16) / 2**32
            if u * gap.sum() < 2 * k * gap[j]:
                taken.append(j)
    taken = sorted(set(taken))
    seeds = x[taken]
    weight = np.bincount(gaps(seeds).argmin(1), minlength=len(seeds))
    if len(seeds) > k:
        order = [int(weight.argmax())]
        while len(order) < k:
            far = ((seeds[:, None] - seeds[order][None]) ** 2).sum(-1).min(1)
            order.append(int((weight * far).argmax()))
        seeds = seeds[order]
    for _ in range(clusters.STEPS):
        near = gaps(seeds).argmin(1)
        seeds = np.array([x[near == c].mean(0) if (near == c).any() else seeds[c] for c in range(len(seeds))])
    return {r.pmid: int(c) for r, c in zip(rows, gaps(seeds).argmin(1))}


@pytest.mark.parametrize("block_rows", [2048, 25])
def test_clusters_follow_their_rule(spark, block_rows):
    rows = runs(spark, [3, 40, 150])
    found = by_run(clusters.cluster_runs(rows, 6, block_rows=block_rows))
    for run, own in by_run(rows).items():
        assert {r.pmid: r.cluster for r in found[run]} == plain_clusters(own, 6)


def test_clusters_of_few_and_of_equal_rows(spark):
    alike = spark.createDataFrame([("T", "p", 0, 1, i, str(i), [1.0, 2.0], 0) for i in range(30)], ROW)
    for block_rows in (2048, 10):
        out = clusters.cluster_runs(alike, 5, block_rows=block_rows)
        assert {r.cluster for r in out.collect()} == {0} and out.count() == 30
        assert out.columns == [*ROUND, "pmid", "draw", "cluster"]
    assert clusters.cluster_runs(alike.where("pmid = 1"), 5).first().cluster == 0
    assert clusters.cluster_runs(alike.where("false"), 5).count() == 0


@pytest.mark.parametrize("block_rows", [2048, 30])
def test_projection_of_each_topic(spark, block_rows):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(50, 1, (90, 4)) @ np.diag([1, 5, 2, 0.1]), "b": rng.normal(0, 1, (70, 4)) @ np.diag([3, 1, 1, 9])}
    rows = [(t, i, x.tolist()) for t, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "topic string, pmid long, features array<double>")
    points = projection.project_topics(df, ["topic", "pmid"], ["topic"], block_rows).collect()
    for topic, xs in data.items():
        _, vectors = np.linalg.eigh(np.cov(xs.T))
        for name, v in (("x", vectors[:, -1]), ("y", vectors[:, -2])):
            v = v * np.sign(v[np.abs(v).argmax()])
            got = {r.pmid: r[name] for r in points if r.topic == topic}
            assert got == pytest.approx(dict(enumerate(xs @ v)), abs=1e-8)


def test_projection_of_single_rows_and_features(spark):
    df = spark.createDataFrame([("a", 1, [2.0]), ("b", 2, [3.0]), ("b", 3, [5.0])], "topic string, pmid long, features array<double>")
    points = projection.project_topics(df, ["topic", "pmid"], ["topic"]).collect()
    assert {(r.pmid, r.x, r.y) for r in points} == {(1, 2.0, 0.0), (2, 3.0, 0.0), (3, 5.0, 0.0)}


def test_blocks_hold_every_row_once(spark):
    packed = blocks.pack(runs(spark, [5, 100]), RUN, ["pmid", "label"], 20).collect()
    for run, n in ((0, 5), (1, 100)):
        own = [r for r in packed if r.run == run]
        assert sorted(p for r in own for p in r.pmid) == list(range(n))
        assert all(r.blocks == -(-n // 20) and len(r.x) == 40 * len(r.pmid) == 40 * len(r.label) for r in own)
