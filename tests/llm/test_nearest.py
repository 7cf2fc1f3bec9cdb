"""Nearest neighbours: recall against brute force, exact scores, unusual vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import nearest
from reviewsieve.llm.frames import table

SCHEMA = "vec_id bigint, embedding array<double>"


def frame(spark, ids, vectors):
    rows = [(None if i is None else int(i), None if v is None else list(map(float, v)))
            for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(ids, vectors, asked, k):
    out = {}
    for q in asked:
        scores = (vectors * vectors[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, monkeypatch, sf):
    monkeypatch.setattr(nearest, "ROW_BLOCK", 2000)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 100)
    vectors = table(spark, f"/root/testdata/{sf}", "embeddings")
    got = collected(nearest.nearest(vectors, vectors.where("vec_id % 20 = 0")))
    rows = vectors.select("vec_id", "embedding").toPandas()
    ids = rows["vec_id"].to_numpy()
    matrix = np.stack(rows["embedding"]).astype(float)
    expected = brute_force(ids, matrix, ids[ids % 20 == 0], 20)
    assert set(got) == set(expected)
    shared = [len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected]
    assert np.mean(shared) / 20 > 0.95
    scores = {(q, v): s for q in expected for v, s in got[q]}
    place = {int(i): n for n, i in enumerate(ids)}
    for (q, v), s in list(scores.items())[::17]:
        assert s == float((matrix[place[q]] * matrix[place[v]]).sum())


def test_norms_differ(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 24)) * rng.gamma(2, 1, size=(3000, 1))
    ids = np.arange(3000)
    df = frame(spark, ids, vectors)
    got = collected(nearest.nearest(df, df.where("vec_id % 100 = 0"), k=10))
    expected = brute_force(ids, vectors, ids[::100], 10)
    shared = [len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected]
    assert np.mean(shared) / 10 > 0.95


def test_ties_and_copies_go_to_the_smaller_id(spark):
    vectors = np.tile([[1.0, 2.0, 0.1]], (300, 1))
    vectors[7] = [5, 5, 5]
    df = frame(spark, np.arange(300), vectors)
    got = collected(nearest.nearest(df, df.where("vec_id in (3, 7)"), k=4))
    assert [v for v, _ in got[3]] == [7, 0, 1, 2] and [v for v, _ in got[7]] == [0, 1, 2, 3]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (20, [0, 0]), (40, None), (1, [nan, 1]), (2, [inf, 1]), (3, [1, 1]), (4, [2, 2, 2]),
            (60, [1, 1, 1]), (None, [1, 1]), (5, []), (3, [1, 1])]
    df = frame(spark, *zip(*rows)).unionByName(
        spark.createDataFrame([(6, [None, 1.0])], SCHEMA)
    )
    df = df.withColumns({"score": F.lit("x"), "width": F.lit(1)})
    got = collected(nearest.nearest(df, df.where("vec_id % 20 = 0")))
    assert got == {0: [(3, 1.0), (3, 1.0)], 60: [(4, 6.0)]}


def test_repeated_queries_are_asked_once(spark):
    rng = np.random.default_rng(6)
    ids, vectors = np.arange(60), rng.normal(size=(60, 5))
    rows = frame(spark, ids, vectors)
    twice = frame(spark, [20, 20, 40, 40], [vectors[20], vectors[20], vectors[40], vectors[40] + 1])
    got = collected(nearest.nearest(rows.union(rows.where("vec_id = 20")), twice, k=7))
    want = brute_force(ids, vectors, [20], 7)
    assert [i for i, _ in got[20]] == [i for i, _ in want[20]]
    first = min(vectors[40].tolist(), (vectors[40] + 1).tolist())
    scores = {int(i): float(v @ first) for i, v in zip(ids, vectors, strict=True) if i != 40}
    assert len(got[40]) == 7 and all(abs(scores[i] - s) < 1e-9 for i, s in got[40])


def test_empty_tables(spark):
    df = frame(spark, [1, 2], [[1, 2], [2, 1]])
    assert nearest.nearest(df.where("false"), df).count() == 0
    assert nearest.nearest(df, df.where("false")).count() == 0


def test_tree_hands_out_every_row_once_in_order():
    points = np.random.default_rng(5).normal(size=(5000, 4))
    points[:700] = points[0]
    tree = nearest.KdTree(points, 64)
    assert sorted(tree.order.tolist()) == list(range(5000)) and tree.bounds[-1] == 5000
    gaps = tree.gaps(points[9])
    for leaf, (a, b) in enumerate(zip(tree.bounds[:-1], tree.bounds[1:])):
        real = ((points[tree.order[a:b]] - points[9]) ** 2).sum(axis=1)
        assert (real >= gaps[leaf] - 1e-9).all() and b - a <= 64


def test_quantiles():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert nearest.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=1e-3)
