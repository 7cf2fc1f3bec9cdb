"""The language model against a plain one over dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewsieve.llm import ngramlm

SCHEMA = "doc_id bigint, text string"
END, START = ("end",), ("start",)


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [END]


class Plain:
    """Interpolated modified Kneser-Ney of order 2, by its formulas."""

    def __init__(self, texts):
        pairs, self.count = Counter(), Counter()
        for text in texts:
            before = START
            for t in tokens(text):
                pairs[before, t] += 1
                self.count[t] += 1
                before = t
        self.pairs = pairs
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.after = defaultdict(Counter)
        self.before = Counter()
        for (a, b), c in pairs.items():
            self.after[a][b] = c
            self.before[b] += 1
        self.d = self.discounts(pairs.values())
        self.e = self.discounts(self.before.values())

    def discounts(self, counts):
        met = Counter(min(c, 5) for c in counts)
        return (0.0, *ngramlm.discounts(met[1], met[2], met[3], met[4]))

    def lower(self, t):
        total = sum(self.before.values())
        if not total:
            return 1 / (self.v + 1)
        spare = sum(self.e[min(c, 3)] for c in self.before.values())
        own = self.before[t]
        return (own - self.e[min(own, 3)]) / total + spare / total / (self.v + 1)

    def log10(self, text):
        out, before = 0.0, START
        for t in tokens(text):
            rows = self.after.get(before)
            p = self.lower(t)
            if rows:
                total = sum(rows.values())
                weight = sum(self.d[min(c, 3)] for c in rows.values()) / total
                c = rows[t]
                p = (c - self.d[min(c, 3)]) / total + weight * p
            out += math.log10(p)
            before = t
        return out

    def base(self, text):
        return sum(
            math.log10((self.count[t] + 0.5) / (self.n + 0.5 * (self.v + 1))) for t in tokens(text)
        )


def corpus(seed=3, n=200):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["É", "the", "The"]
    return [" ".join(rng.choices(words, weights=range(63, 0, -1), k=rng.randrange(30))) for _ in range(n)]


def check(spark, learn, asked):
    train = spark.createDataFrame([(i, t) for i, t in enumerate(learn)], SCHEMA).repartition(5)
    model = ngramlm.train(train)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], SCHEMA)
    plain = Plain(learn)
    for r in ngramlm.score(docs, model).collect():
        text = asked[r["doc_id"]]
        own = tokens(text)
        assert r["n_tokens"] == len(own) and r["train_tokens"] == plain.n
        assert r["n_known"] == sum(plain.count[t] > 0 for t in own)
        assert r["score"] == pytest.approx(plain.log10(text), rel=1e-11)
        assert r["base_score"] == pytest.approx(plain.base(text), rel=1e-11)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(own)))
    return model


def test_scores_equal_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(ngramlm, "CHUNK_TOKENS", 100)
    learn = corpus()
    asked = [*corpus(4, 30), "new words only", None, "", " \t\n", "w1 " * 20_000, "ÉA\x1fb  c"]
    check(spark, [*learn, None, ""], asked)


def test_probabilities_sum_to_one():
    plain = Plain(corpus())
    for before in ("w3", "unknown"):
        rows = plain.after.get(before, Counter())
        total = sum(rows.values())
        sums = 0.0
        for t in [*plain.count, "one unknown token"]:
            p = plain.lower(t)
            if rows:
                weight = sum(plain.d[min(c, 3)] for c in rows.values()) / total
                p = (rows[t] - plain.d[min(rows[t], 3)]) / total + weight * p
            sums += p
        assert sums == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    check(spark, [], ["a b", None])


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")] * 2 + [(None, "a", 5, "x")], SCHEMA + ", score int, n_tokens string")
    rows = ngramlm.score(df, ngramlm.train(df)).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2


def test_tokens_follow_the_pattern():
    texts = ["A\x0bb\x85c  d", "", "x"]
    token, before, bounds = ngramlm.tokens(texts)
    assert np.diff(bounds).tolist() == [len(tokens(t)) for t in texts]
    assert before[bounds[:-1]].tolist() == [int(ngramlm.START)] * 3
    assert token[bounds[1:] - 1].tolist() == [int(ngramlm.END)] * 3
    assert ngramlm.tokens(["a B"])[0].tolist() == ngramlm.tokens(["A b"])[0].tolist()
