import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.functions.text import explode_words
from reviewsieve.operators import docvectors

ARTICLES = [
    ("T", 1, "Alpha beta, ALPHA gamma!", "beta beta unknown"),
    ("T", 2, "nothing known", ""),
    ("U", 3, "", "alpha"),
    ("U", 4, None, "the the the beta"),
]
VECTORS = {"alpha": [1.0, 2.0], "beta": [0.5, -4.0], "gamma": [3.0, 3.0], "the": [7.0, 1.0]}


def words(text):
    runs = re.findall(r"(?:(?!\d)\w)+", (text or "").lower())
    return [w for w in runs if 2 <= len(w) <= 15 and not w.startswith("_")]


def mean(text):
    known = [VECTORS[w] for w in words(text) if w in VECTORS]
    return list(np.mean(known, axis=0)) if known else [0.0, 0.0]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "topic string, pmid long, title string, abstract string")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "word string, vector array<float>")


@pytest.mark.parametrize("limit", [10**9, 150, 60])
def test_slices_give_the_means(articles, vectors, limit):
    out = docvectors.document_vectors(articles, vectors, ["topic", "pmid"], limit)
    got = {r.pmid: r.features for r in out.collect()}
    for _, pmid, title, abstract in ARTICLES:
        assert got.pop(pmid) == pytest.approx(mean(title) + mean(abstract))
    assert not got


def test_measured_vocabulary_is_broadcast(articles, vectors, capsys):
    docvectors.document_vectors(articles, vectors, ["pmid"], 10**9).explain()
    assert "BroadcastHashJoin [word" in capsys.readouterr().out


def test_vectors_of_different_width_are_refused(spark, articles):
    bad = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "word string, vector array<float>")
    with pytest.raises(ValueError, match="one width"):
        docvectors.document_vectors(articles, bad, ["pmid"])


def test_words_are_those_of_the_word_rule(spark):
    texts = ["a be _see s3 4x abc4def", "É è straße naïve", "x" * 15 + " " + "y" * 16, "don't e-mail", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {i: [] for i in range(len(texts))}
    for r in explode_words(df, ["id"], "t").collect():
        got[r.id].append(r.word)
    assert got == {i: words(t) for i, t in enumerate(texts)}


def test_shuffled_order_is_whole_and_repeatable(articles):
    one = docvectors.shuffled_articles(articles).select("topic", "pmid", "pos").collect()
    two = docvectors.shuffled_articles(articles.repartition(7)).select("topic", "pmid", "pos").collect()
    assert sorted(one) == sorted(two)
    assert sorted((r.topic, r.pos) for r in one) == [("T", 1), ("T", 2), ("U", 1), ("U", 2)]
    other = docvectors.shuffled_articles(articles.sparkSession.range(50).select(
        F.lit("T").alias("topic"), F.col("id").alias("pmid")), seed=1)
    assert [r.pmid for r in other.orderBy("pos").collect()] != list(range(50))


@pytest.mark.parametrize("limit", [10**9, 20_000])
def test_wide_vectors(spark, articles, limit):
    wide = {w: [float(i + len(w)) for i in range(300)] for w in VECTORS}
    vectors = spark.createDataFrame(list(wide.items()), "word string, vector array<float>")
    out = docvectors.document_vectors(articles, vectors, ["pmid"], limit // 10)
    for r in out.collect():
        title, abstract = next((a[2], a[3]) for a in ARTICLES if a[1] == r.pmid)
        for field, part in ((title, r.features[:300]), (abstract, r.features[300:])):
            known = [wide[w] for w in words(field) if w in wide]
            assert part == pytest.approx(list(np.mean(known, axis=0)) if known else [0.0] * 300)


def test_only_sum_vectors_are_shuffled(articles, vectors):
    plan = docvectors.document_vectors(articles, vectors, ["topic", "pmid"], 60)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text


def test_shuffled_articles_keep_null_topics(spark):
    rows = [("T" if i % 2 else None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "topic string, pmid long")
    out = docvectors.shuffled_articles(df).collect()
    assert sorted(r.pos for r in out if r.topic is None) == list(range(1, 11)) and len(out) == 20


def test_a_vocabulary_above_the_limit_is_not_broadcast(articles, vectors):
    plan = docvectors.document_vectors(articles, vectors, ["topic", "pmid"], 60)
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_blocks_give_what_the_broadcast_gives(spark):
    rows = [
        ("T" if i % 3 else None, None if i % 7 == 0 else i % 20, f"w{'abcdefgh'[i % 8]} wc wzz", "wa wb " * (i % 4))
        for i in range(60)
    ] + [("T", 100, None, None), (None, None, "", "none")]
    vectors = [(f"w{c}", [float(i), -1.5 * i, 2.0]) for i, c in enumerate("abcdefg")]
    vectors.append(("wc", [0.25, 0.5, 1.0]))  # a second vector of a word counts as another word
    left = spark.createDataFrame(rows, "topic string, pmid long, title string, abstract string")
    right = spark.createDataFrame(vectors, "word string, vector array<float>")

    def found(*limits):
        out = docvectors.document_vectors(left, right, ["topic", "pmid"], *limits).collect()
        assert len({(r.topic, r.pmid) for r in out}) == len(out)
        return {(r.topic, r.pmid): r.features for r in out}

    whole = found(10**9)
    for block_bytes in (10**9, 300):
        blocks = found(0, block_bytes)
        assert blocks.keys() == whole.keys()
        for key, features in whole.items():
            assert blocks[key] == pytest.approx(features)


def test_word_counts_take_rows_of_one_key_as_one_article(spark):
    rows = [(1, "one two one", "two"), (2, "one", None), (2, "one two", "x yy yy"), (None, "one", ""), (None, "one", "yy")]
    many = spark.createDataFrame(rows, "pmid long, title string, abstract string")
    got = {(r.field, r.word): (r.articles, r.occurrences) for r in docvectors.word_counts(many, ["pmid"]).collect()}
    assert got == {
        ("title", "one"): (3, 6), ("title", "two"): (2, 2), ("abstract", "two"): (1, 1), ("abstract", "yy"): (2, 3),
    }


def test_words_of_articles_of_one_row_are_counted_before_the_shuffle(articles):
    counted = docvectors.word_counts(articles, ["topic", "pmid"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(exchanges) == 1 and "pmid" not in exchanges[0]
    got = {(r.field, r.word): (r.articles, r.occurrences) for r in counted.collect()}
    assert got["title", "alpha"] == (1, 2) and got["abstract", "the"] == (1, 3) and got["abstract", "beta"] == (2, 3)
