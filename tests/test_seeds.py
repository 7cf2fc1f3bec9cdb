import hashlib

import pytest
from pyspark.sql import functions as F

from reviewsieve.operators import seeds


def judged(spark):
    rows = [("A", i, int(i % 9 == 0)) for i in range(60)]
    rows += [("B", 100 + i, 0) for i in range(5)] + [("C", 200, 1), ("C", 201, 0)]
    rows += [("D", 300 + i, i % 3) for i in range(9)]
    return spark.createDataFrame(rows, "topic string, pmid long, label int")


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def drawn_pool(rows, size, *prefix):
    order = sorted(rows, key=lambda r: (digest(*prefix, r[1]), r[1]))
    lead = [next((r for r in order if r[2] == c), None) for c in (0, 1)]
    lead = [r for r in lead if r]
    return (lead + [r for r in order if r not in lead])[:size]


def by_topic(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r.topic, []).append((r.topic, r.pmid, r.label))
    return rows


def test_start_pool_takes_both_classes_then_fills(spark):
    df = judged(spark)
    for size in (1, 4, 40):
        got = {}
        for r in seeds.start_pool(df, size, seed=5).orderBy("topic", "rank_in_round").collect():
            got.setdefault(r.topic, []).append((r.topic, r.pmid, r.label))
        want = {t: drawn_pool(rows, max(2, size), 5) for t, rows in by_topic(df).items()}
        assert got == want


def test_seed_pools_are_distinct_ordered_and_topped_up(spark):
    df = judged(spark)
    got = {}
    for r in seeds.seed_pools(df, 4, 3).orderBy("topic", "pool_id").collect():
        got.setdefault(r.topic, []).append((r.attempt, r.pmids))
        assert r.both_classes == (r.topic != "B")
    for topic, rows in by_topic(df).items():
        seen, want = set(), []
        for attempt in range(40):
            ids = sorted(r[1] for r in drawn_pool(rows, 3, 0, attempt))
            if tuple(ids) not in seen and len(want) < 4:
                seen.add(tuple(ids))
                want.append((attempt, ids))
        assert got[topic] == want
    short = seeds.short_topics(seeds.seed_pools(df, 4, 3), 4).collect()
    assert [(r.topic, r.pools) for r in short] == [("C", 1)]


def test_given_pool(spark):
    df = judged(spark)
    pool = spark.createDataFrame([("A", 1, 9), ("A", 2, 4)], "topic string, rank_in_round int, pmid long")
    got = seeds.given_pool(df, pool).orderBy("rank_in_round").collect()
    assert [(r.pmid, r.label) for r in got] == [(9, 1), (4, 0)]
    with pytest.raises(ValueError, match="777"):
        seeds.given_pool(df, pool.withColumn("pmid", F.lit(777).cast("long")))


@pytest.mark.parametrize("looked_at", [(4, 24), (1, 0)])
def test_low_draws_hold_the_first_of_every_class_and_attempt(spark, monkeypatch, looked_at):
    """With a limit that is met, and with one so low that many classes are drawn again."""
    monkeypatch.setattr(seeds, "LOOKED_AT", looked_at[0])
    monkeypatch.setattr(seeds, "AT_LEAST", looked_at[1])
    rows = [(t, i, int(i % 7 == 0) if i % 50 else None) for t in ("A", None) for i in range(400)]
    df = spark.createDataFrame(rows, "topic string, pmid long, label int")
    low = seeds._low_draws(df, 3, 9, 4, 1).collect()
    assert len({(r.topic, r.attempt, r.pmid) for r in low}) == len(low) < 0.6 * 7 * len(rows)
    cls = lambda label: label if label in (0, 1) else 2
    for topic in ("A", None):
        for attempt in range(3, 10):
            for c in (0, 1, 2):
                own = [i for t, i, label in rows if t == topic and cls(label) == c]
                want = sorted(own, key=lambda i: (digest(1, attempt, i), i))[:4]
                got = {r.pmid for r in low if (r.topic, r.attempt, cls(r.label)) == (topic, attempt, c)}
                assert set(want) <= got
