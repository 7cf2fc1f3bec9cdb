"""Ranks, sums and lags in buckets equal plain windows, with one group holding most rows."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewsieve.functions import ranking
from reviewsieve.functions.hashing import draw, unit_draw


def rows(spark, n=600):
    rng = random.Random(1)
    ids = rng.sample(range(1_000_000), n)
    data = [("hot" if i % 5 else f"t{i % 3}", i * 7, ident, rng.random()) for i, ident in enumerate(ids)]
    return spark.createDataFrame(data, "g string, step long, id long, v double").withColumn(
        "d", draw(3, "id")
    )


def plain(df, order, name="pos"):
    return df.withColumn(name, F.row_number().over(Window.partitionBy("g").orderBy(*order)))


def same(a, b, columns):
    left = sorted(tuple(r) for r in a.select(*columns).collect())
    right = sorted(tuple(r) for r in b.select(*columns).collect())
    assert left == right


def test_draw_rank_and_its_limit(spark):
    df = rows(spark)
    whole = plain(df, ["d", "id"])
    same(ranking.draw_rank(df, ["g"], "d", ["id"]), whole, ["g", "id", "pos"])
    same(ranking.draw_rank(df, ["g"], "d", ["id"], k=150), whole.where("pos <= 150"), ["g", "id", "pos"])


def test_id_rank(spark):
    df = rows(spark)
    same(ranking.id_rank(df, ["g"], "id", width=1000), plain(df, ["id"]), ["g", "id", "pos"])


def test_range_rank_with_ties(spark):
    df = rows(spark).withColumn("v", F.round("v", 1))
    order = [F.desc("v"), F.col("d"), F.col("id")]
    same(ranking.range_rank(df, ["g"], order), plain(df, order), ["g", "id", "pos"])


def test_first_k_small_and_large(spark, monkeypatch):
    df = rows(spark)
    order = [F.col("v"), F.col("id")]
    want = plain(df, order).where("pos <= 120")
    same(ranking.first_k(df, ["g"], order, 120, "pos", "id"), want, ["g", "id", "pos"])
    monkeypatch.setattr(ranking, "GROUP_LIMIT", 10)
    same(ranking.first_k(df, ["g"], order, 120, "pos", "id"), want, ["g", "id", "pos"])
    drawn = plain(df, ["d", "id"]).where("pos <= 120")
    same(ranking.first_k_drawn(df, ["g"], "d", ["id"], 120, "pos"), drawn, ["g", "id", "pos"])


def test_group_limit_reaches_the_plan(spark, capsys):
    ranking.first_k(rows(spark), ["g"], [F.col("v")], 5, "pos", "id").explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_sums_before_and_previous(spark):
    df = rows(spark)
    w = Window.partitionBy("g").orderBy("step")
    want = df.withColumn(
        "s", F.coalesce(F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("prev_v", F.lag("v").over(w))
    same(ranking.sums_before(df, ["g"], "step", {"s": "id"}, width=64), want, ["g", "step", "s"])
    got = ranking.with_previous(df, ["g"], "step", ["v"], width=64)
    key = ["g", "step"]
    pairs = got.join(want.select(*key, F.col("prev_v").alias("w")), key)
    assert pairs.count() == df.count()
    assert pairs.where(~F.col("prev_v").eqNullSafe(F.col("w"))).count() == 0


def test_draws_do_not_hang_on_partitions(spark):
    df = rows(spark)
    first = [
        sorted(r.id for r in ranking.first_k_drawn(df.repartition(n), ["g"], "d", ["id"], 9, "p").collect())
        for n in (1, 4, 64)
    ]
    assert first[0] == first[1] == first[2]
    low, high = df.select(F.min(unit_draw("id")), F.max(unit_draw("id"))).first()
    assert 0 <= low < 0.1 and 0.9 < high < 1


@pytest.mark.parametrize("k", [1000, 1001])
def test_null_groups_are_ranked_on_both_sides_of_the_limit(spark, k):
    df = spark.createDataFrame([(None if i % 2 else "T", i, f"{i * 37 % 101:03x}") for i in range(20)],
                               "topic string, pmid long, d string")
    for ranked in (
        ranking.first_k(df, ["topic"], [F.col("d")], k, "pos"),
        ranking.first_k_drawn(df, ["topic"], "d", ["pmid"], k, "pos"),
        ranking.draw_rank(df, ["topic"], "d", ["pmid"], "pos", k),
    ):
        rows = ranked.collect()
        for topic in (None, "T"):
            own = sorted((r.d, r.pos) for r in rows if r.topic == topic)
            assert [p for _, p in own] == list(range(1, 11))


def test_null_groups_keep_sums_and_previous_rows(spark):
    df = spark.createDataFrame([(None, i, i * i) for i in range(10)], "topic string, step long, v long")
    sums = {r.step: r.s for r in ranking.sums_before(df, ["topic"], "step", {"s": "v"}, width=3).collect()}
    assert sums == {i: sum(j * j for j in range(i)) for i in range(10)}
    prev = {r.step: r.prev_v for r in ranking.with_previous(df, ["topic"], "step", ["v"], width=3).collect()}
    assert prev == {i: (i - 1) ** 2 if i else None for i in range(10)}
    ids = {r.step: r.pos for r in ranking.id_rank(df, ["topic"], "step", width=4).collect()}
    assert ids == {i: i + 1 for i in range(10)}


def test_sparse_ids_are_ranked_in_levels(spark, monkeypatch):
    """Random 64-bit ids, hence a bucket for each; no window holds more than a level's buckets."""
    import numpy as np

    monkeypatch.setattr(ranking, "LEVEL_BITS", 6)
    rng = np.random.default_rng(8)
    ids = np.unique(rng.integers(-(2**63), 2**63 - 1, 3000)).tolist() + [-(2**63), 2**63 - 1, 0, -1]
    rows = [(t, i) for t in ("a", None) for i in ids]
    df = spark.createDataFrame(rows, "topic string, pmid long").repartition(7)
    got = {(r.topic, r.pmid): r.pos for r in ranking.id_rank(df, ["topic"], "pmid", 1024).collect()}
    want = {i: n for n, i in enumerate(sorted(ids), start=1)}
    assert got == {(t, i): want[i] for t, i in rows}
