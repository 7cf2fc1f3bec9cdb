"""Sharding against its own law: sizes, gapless slots, and how often rows fall where."""

import numpy as np
from pyspark.sql import functions as F

from reviewsieve.llm import sharding


def check(rows, total, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, ())) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sizes_slots_and_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    df = spark.range(5003, numPartitions=7).withColumn("shard", F.lit("old"))
    rows = sharding.shuffle_into_shards(df, 24).collect()
    check(rows, 5003, 24)
    assert sorted(r["id"] for r in rows) == list(range(5003))
    assert sharding.shuffle_into_shards(df, 24).columns == ["id", "shard", "slot"]


def test_equal_rows_nulls_and_few_rows(spark):
    df = spark.createDataFrame([(None, "x")] * 40 + [(1, None)], "doc_id bigint, text string")
    check(sharding.shuffle_into_shards(df, 24).collect(), 41, 24)
    check(sharding.shuffle_into_shards(df.limit(3), 24).collect(), 3, 24)


def test_empty_table(spark):
    assert sharding.shuffle_into_shards(spark.range(0), 24).count() == 0


def test_seed_decides(spark):
    df = spark.range(500, numPartitions=4)
    one, two, other = (
        {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, 5, s).collect()}
        for s in (1, 1, 2)
    )
    assert one == two and one != other


def test_matrix_has_its_margins_and_mean():
    parts, sizes = np.array([10, 0, 300, 90]), sharding.shard_sizes(400, 7)
    drawn = [sharding.communication_matrix(parts, sizes, s) for s in range(400)]
    for m in drawn:
        assert (m.sum(axis=1) == parts).all() and (m.sum(axis=0) == sizes).all()
    mean = np.mean(drawn, axis=0)
    assert np.abs(mean - np.outer(parts, sizes) / 400).max() < 1.5
    var = np.var([m[2, 0] for m in drawn])
    n, good, total = 300, int(sizes[0]), 400
    law = n * good / total * (1 - good / total) * (total - n) / (total - 1)
    assert 0.75 * law < var < 1.3 * law


def test_large_populations_keep_the_law():
    rng = np.random.default_rng(3)
    big = [sharding._hypergeometric(rng, 2 * 10**9, 6 * 10**9, 400) for _ in range(400)]
    assert abs(np.mean(big) - 100) < 3 and 50 < np.var(big) < 105
    for draws in (3, 2 * 10**9, 8 * 10**9 - 1):
        assert 0 <= sharding._hypergeometric(rng, 2 * 10**9, 6 * 10**9, draws) <= min(draws, 2 * 10**9)
    assert sharding._hypergeometric(rng, 2 * 10**9, 6 * 10**9, 8 * 10**9) == 2 * 10**9


def test_places_are_uniform(spark):
    df = spark.range(48, numPartitions=3)
    first = [
        next(r["shard"] for r in sharding.shuffle_into_shards(df, 4, s).collect() if r["id"] == 0)
        for s in range(40)
    ]
    assert all(1 <= first.count(s) <= 22 for s in range(4))
