"""Language models: distributions, held-out accuracy, rejection and unusual rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import langid, wordhash
from reviewsieve.llm.frames import remainder, table

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string"


def counts(texts, order=4):
    out = {}
    for lang, text in texts:
        points, _ = wordhash.letter_stream([text], order - 1)
        chars = "".join(map(chr, points.tolist()))
        own = out.setdefault(lang, {})
        for i in range(len(chars) - order + 1):
            own[chars[i : i + order]] = own.get(chars[i : i + order], 0) + 1
    return out


TEXTS = [("aa", "the cat sat on the mat and the rat"), ("bb", "le chat est sur la table et le rat")]


def test_letter_stream():
    points, bounds = wordhash.letter_stream(["Ab,  c1d!", "", "..é", None or "x"], 2)
    parts = ["".join(map(chr, points[a:b].tolist())) for a, b in zip(bounds, bounds[1:])]
    assert parts == ["  ab c d ", "   ", "   é ", "  x "] or parts == ["  ab c d ", "   ", "  é ", "  x "]


def test_each_context_is_a_distribution():
    model = langid.build(counts(TEXTS))
    letters = sorted({c for _, t in TEXTS for c in t} | {" "})
    for context in ("the", "xat", "qqq", " la", "   "):
        texts = np.array([[ord(c) for c in context + x] for x in letters], np.uint64)
        points = texts.ravel()
        ends = np.arange(len(letters)) * 4 + 3
        total = np.exp(langid.log_probabilities(model, points, ends).astype(float)).sum(axis=0)
        unseen = np.exp(langid.log_probabilities(
            model, np.array([*map(ord, context), 0x4E00], np.uint64), np.array([3])).astype(float))[0]
        assert np.allclose(total + unseen, 1, atol=1e-4), context


def test_held_out_accuracy_and_few_rejections(spark):
    docs = table(spark, SF_DIR, "documents")
    found = langid.identify(docs, langid.train(docs.where(remainder("doc_id", 5) != 0), 100))
    rows = (
        found.join(docs.select("doc_id", "lang"), "doc_id")
        .where(remainder("doc_id", 5) == 0)
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")))
        .first()
    )
    assert rows[0] > 0.97 and rows[1] < 0.005


def test_rejects_what_no_model_knows(spark):
    docs = table(spark, SF_DIR, "documents")
    model = langid.train(docs, 100)
    odd = spark.createDataFrame([(1, "zxq wvk qqj xzz kkw vvq " * 40, None), (2, "дом стоит " * 40, None)], SCHEMA)
    assert [r["rejected"] for r in langid.identify(odd, model).collect()] == [True, True]


def test_unusual_rows(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(TEXTS * 20)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    odd = [(1, None, "aa"), (2, "", "x"), (3, "12 !?", None), (None, "the cat", None), (5, "le chat", "aa"),
           (5, "le chat", "aa"), (6, "the mat " * 40_000, None)]
    got = langid.identify(
        spark.createDataFrame(odd, SCHEMA).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s")), model
    ).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [
        (1, "und"), (2, "und"), (3, "und"), (None, "aa"), (5, "bb"), (5, "bb"), (6, "aa")
    ]
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["rejected"] for r in got[:3])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None)], SCHEMA)
    assert langid.train(docs) is None
    assert langid.identify(docs, None).first()["lang_pred"] == "und"
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.identify(empty, langid.train(spark.createDataFrame([(1, "abc", "l")] * 9, SCHEMA))).count() == 0


def test_language_whose_texts_all_fall_to_calibration(spark):
    mark = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 20)) / float(1 << 20)
    late = spark.range(50).where(mark >= 2.0 / 3).first()["id"]
    rows = [(i, f"the cat and dog number {i} sat on a mat", "en") for i in range(100, 130)]
    rows += [(late, "zażółć gęślą jaźń źdźbło", "pl")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.value.languages == ["en", "pl"]
    assert np.isfinite(model.value.limit[0]) and np.isinf(model.value.limit[1])
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(docs, model).collect()}
    assert got[late] == ("pl", False)


def plain_stream(text, pad):
    """Letters in lower case, other signs one blank between them, blanks around."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return " " * pad + "".join(run + " " for run in runs) if runs else " " * pad + " "


class PlainKneserNey:
    """Interpolated Kneser-Ney by its definition, over dictionaries, for one language."""

    def __init__(self, counts, order, alphabet):
        self.levels = [Counter(counts)]
        for _ in range(order - 1):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.alphabet = alphabet
        self.discount = []
        for level in self.levels:
            one, two = (sum(c == n for c in level.values()) for n in (1, 2))
            self.discount.append(min(0.9, max(0.1, one / max(one + 2 * two, 1))))

    def probability(self, gram):
        if not gram:
            return 1 / (self.alphabet + 1)
        level, d = self.levels[len(gram) - 1], self.discount[len(gram) - 1]
        same = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        below = self.probability(gram[1:])
        if not total:
            return below
        return max(level.get(gram, 0) - d, 0) / total + d * len(same) / total * below

    def cross_entropy(self, text, order):
        s = plain_stream(text, order - 1)
        logs = [math.log(self.probability(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]
        return -sum(logs) / len(logs)


LEARNED = {
    "aa": ["the cat sat on the mat", "a cat; the Cat!!", "mat 12 mat", "that is the hat", ""],
    "bb": ["der hut ist gut", "Übermut tut selten gut", "das ist das", "hut", "ßß 3"],
    "cc": ["el gato es el gato", "ñandú", "la la la la"],
}


@pytest.mark.parametrize("order", [2, 4])
def test_models_equal_plain_kneser_ney(order):
    counts = {
        lang: Counter(
            s[i : i + order]
            for s in (plain_stream(t, order - 1) for t in texts)
            for i in range(len(s) - order + 1)
        )
        for lang, texts in LEARNED.items()
    }
    alphabet = len({g[-1] for by in counts.values() for g in by})
    model = langid.build({k: dict(v) for k, v in counts.items()}, order)
    plain = {lang: PlainKneserNey(by, order, alphabet) for lang, by in counts.items()}
    texts = ["the hat", "gut, das ist der Hut", "xyz qqq", "", "!!!", "ñandú el mat über", "a" * 50, *LEARNED["cc"]]
    found, _ = langid.cross_entropies(model, texts)
    for text, row in zip(texts, found, strict=True):
        want = [plain[lang].cross_entropy(text, order) for lang in model.languages]
        assert row == pytest.approx(want, abs=2e-5), text
