"""The classifier: its fit, its held-out quality, and unusual rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import toxicity
from reviewsieve.llm.frames import remainder, table

SF_DIR = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    one = labels == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / one.sum() / (~one).sum()


def test_held_out_quality(spark):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 4) != 2))
    found = toxicity.score(docs, model).join(labels, "doc_id").where(remainder("doc_id", 4) == 2).toPandas()
    toxic, predicted = found["toxic"].to_numpy(), found["predicted"].to_numpy()
    assert auc(toxic, found["score"].to_numpy()) > 0.97
    hit = (toxic == 1) & (predicted == 1)
    assert hit.sum() / (toxic == 1).sum() > 0.9 and hit.sum() / max(predicted.sum(), 1) > 0.9


def test_fit_is_the_minimum():
    rng = np.random.default_rng(1)
    dense = (rng.random((200, 12)) < 0.3).astype(float)
    scale = rng.normal(size=12)
    labels = (rng.random(200) < 1 / (1 + np.exp(-dense @ scale * 2 + 0.5))).astype(float)
    rows, columns = np.nonzero(dense)
    weight, bias = toxicity.fit_logistic(rows, columns, scale, labels, 1.0)
    x = dense * scale
    p = 1 / (1 + np.exp(-(x @ weight + bias)))
    assert np.abs(x.T @ (p - labels) + weight).max() < 0.05 and abs((p - labels).sum()) < 0.05


def test_features_stay_inside_texts():
    text, bucket = toxicity._features(["ab", "cd", "", "abcd"], (3,), None)
    alone = [toxicity._features([t], (3,), None)[1] for t in ("ab", "cd", "", "abcd")]
    assert [bucket[text == i].tolist() for i in range(4)] == [a.tolist() for a in alone]


def toy(spark):
    rows = [(i, ("you scum " if i % 3 == 0 else "good day ") + f"word{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    return docs, labels


def test_unusual_rows(spark):
    docs, labels = toy(spark)
    labels = labels.unionByName(spark.createDataFrame([(0, None), (None, 1)], "doc_id bigint, toxic int"))
    model = toxicity.train(docs, labels)
    odd = [(1, None), (2, ""), (3, "!!"), (None, "scum"), (4, "SCUM, you"), (4, "SCUM, you"), (5, "day " * 50_000)]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({"score": F.lit("x"), "predicted": F.lit(9)})
    rows = toxicity.score(df, model).collect()
    assert [r["doc_id"] for r in rows] == [r[0] for r in odd]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    assert rows[4]["score"] == rows[5]["score"] and rows[4]["predicted"] == 1 and rows[6]["predicted"] == 0


def test_no_labels_and_one_kind(spark):
    docs, labels = toy(spark)
    assert toxicity.train(docs, labels.where("false")) is None
    assert toxicity.score(docs, None).where("score <> 0 or predicted <> 0").count() == 0
    model = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0
    assert toxicity.score(docs.where("false"), model).count() == 0


def plain_grams(text):
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = " " + "".join(run + " " for run in runs) if runs else "  "
    return {s[i : i + n] for n in toxicity.SIZES for i in range(len(s) - n + 1)}


def plain_scores(learned, asked):
    """Log-count ratios by their definition, then Newton steps on the whole dense matrix."""
    held = [(plain_grams(text), label) for text, label in learned]
    sides = [sum(label == side for _, label in held) for side in (0, 1)]
    grams = sorted(set().union(*(g for g, _ in held)))
    count = {g: [sum(g in own and label == side for own, label in held) for side in (0, 1)] for g in grams}
    ratio = np.array([
        math.log((count[g][1] + 1) / (sides[1] + 2)) - math.log((count[g][0] + 1) / (sides[0] + 2)) for g in grams
    ])
    matrix = lambda texts: np.array([[g in own for g in grams] for own in map(plain_grams, texts)]) * ratio
    x = np.c_[matrix([t for t, _ in learned]), np.ones(len(learned))]
    y = np.array([label for _, label in learned], float)
    ridge = np.diag([toxicity.PENALTY] * len(grams) + [1e-6])
    w = np.zeros(len(grams) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return 1 / (1 + np.exp(-np.c_[matrix(asked), np.ones(len(asked))] @ w))


def test_scores_equal_plain_log_count_ratios(spark):
    rng = np.random.default_rng(2)
    plain, bad = "sun moon tree lake bird".split(), "vile scum rot".split()
    learned = []
    for i in range(24):
        label = int(i % 3 == 0)
        words = rng.choice(plain, 4).tolist() + rng.choice(bad if label else plain, 2).tolist()
        learned.append((" ".join(words) + "!" * (i % 2), label))
    asked = ["vile bird", "sun, moon", "", "SCUM scum", "lake rot tree", "other words", *[t for t, _ in learned[:4]]]
    rows = [(i, text) for i, (text, _) in enumerate(learned)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(learned)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.probabilities(model.value, asked)
    assert found == pytest.approx(plain_scores(learned, asked), abs=5e-3)
