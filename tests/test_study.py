"""Entry points over whole studies."""

import pytest
from pyspark.sql import functions as F

from reviewsieve.operators import coverage, curves
from reviewsieve.plans.study import compare_policies, load_topics
from reviewsieve.session import cut_lineage

ROWS = [
    ("T", "0", "1", "1", "alpha beta", "beta", 1), ("T", "0", "2", "0", "gamma", "", 2),
    ("T", "0", "1", "1", "alpha", "beta beta", 3), ("U", "0", "3", "0", None, "alpha", 4),
]


@pytest.fixture(scope="module")
def inputs(spark):
    rows = spark.createDataFrame(
        ROWS, "CD string, Misc string, PMID string, label string, title string, abstract string, seq long"
    )
    words = [("alpha", [1.0, 2.0]), ("beta", [0.0, 4.0])]
    return rows, spark.createDataFrame(words, "word string, vector array<float>")


def test_load_topics_takes_last_versions_and_keeps_the_table(spark, inputs, tmp_path):
    rows, vectors = inputs
    loaded = {(r.topic, r.pmid): r for r in load_topics(spark, rows, vectors, f"{tmp_path}/kept").collect()}
    assert set(loaded) == {("T", "1"), ("T", "2"), ("U", "3")}
    assert loaded["T", "1"].features == [1.0, 2.0, 0.0, 4.0]
    assert loaded["T", "2"].features == [0.0] * 4 and loaded["U", "3"].features == [0.0, 0.0, 1.0, 2.0]
    assert sorted(r.pos for k, r in loaded.items() if k[0] == "T") == [1, 2]
    again = load_topics(spark, rows.where("false"), vectors, f"{tmp_path}/kept")
    assert {(r.topic, r.pmid) for r in again.collect()} == set(loaded)
    with pytest.raises(ValueError, match="built with"):
        load_topics(spark, rows, vectors, f"{tmp_path}/kept", seed=7)


def test_comparison_holds_what_its_parts_give(spark):
    rows = [("t", i, [float(i % 7), float(i % 4)], int(i % 5 == 0)) for i in range(30)]
    judged = spark.createDataFrame(rows, "topic string, pmid long, features array<double>, label int")
    log = cut_lineage(
        judged.select(
            "topic", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("policy"), F.lit(0).alias("run"),
            F.floor(F.col("pmid") / 5).cast("int").alias("round"),
            (F.col("pmid") % 5 + 1).cast("int").alias("rank_in_round"), "pmid", "label",
        )
    )
    study = compare_policies(log, judged, judged)
    assert {r.policy for r in study.summary.collect()} == {"a", "b"}
    both = curves.recall_curve(log, judged).join(
        coverage.coverage_curve(log, judged), ["topic", "policy", "run", "round"]
    )
    for y, band in (("recall_pct", study.recall_band), ("coverage_pct", study.coverage_band)):
        expected = curves.curve_band(curves.curve_grid(both, y), y)
        key = lambda df: sorted((r.policy, r.grid, r.mean) for r in df.collect())
        assert key(band) == key(expected)
