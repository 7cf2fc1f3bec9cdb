"""Language identification by interpolated Kneser-Ney models of characters, one per language.

Texts are read as letters in lower case, with one blank for each run of other signs. The
models of all languages share sorted arrays of n-gram hashes; beside each hash stand the log
probabilities of its last character in every language, interpolated down to single
characters already, so a character takes one search. A text goes to the language of the
lowest cross-entropy per character. It is rejected if that is above what nearly all
calibration texts of the language have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm import wordhash
from reviewsieve.llm.frames import bounded_batches, keep_rows, texts_of

ORDER = 4
# About so many texts of each language are learned from, and half as many calibrate.
TEXTS_PER_LANGUAGE = 2000
# A language's limit: what this share of its calibration texts exceeds, and nats on top. A
# text of n characters may exceed it by SHORT / sqrt(n), for short texts scatter.
REJECTED_SHARE = 0.001
MARGIN = 0.75
SHORT = 4.0
UNKNOWN = "und"


@dataclass
class CharModel:
    languages: list[str]
    #: Per order from 1: hashes, log probabilities [n-gram, language].
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: Per order from 2: hashes of contexts, log weight of the lower order [context, language].
    contexts: list[tuple[np.ndarray, np.ndarray]]
    limit: np.ndarray | None = None

    def index(self) -> None:
        self.find = [wordhash.HashArray(h) for h, _ in self.grams]
        self.find_context = [wordhash.HashArray(h) for h, _ in self.contexts]


def _grams(order: int):
    """Counts of the top n-grams of each language in a batch, spelt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = texts_of(batch.column("text"))
            rows: list[tuple[str, str, int]] = []
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for begin, end in wordhash.batches(own):
                    points, bounds = wordhash.letter_stream(own[begin:end], order - 1)
                    hashes, inside = _windows(points, bounds, order)
                    _, at, count = np.unique(hashes[inside], return_index=True, return_counts=True)
                    places = np.flatnonzero(inside)[at]
                    spelt = points.astype(np.uint32)
                    rows += [
                        (lang, spelt[p : p + order].tobytes().decode("utf-32-le", "replace"), int(n))
                        for p, n in zip(places.tolist(), count.tolist(), strict=True)
                    ]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                 pa.array(columns[2], pa.int64())],
                ["lang", "gram", "n"],
            )

    return run


def _windows(points: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams at all places, and which of them lie inside one text."""
    hashes = wordhash.runs(points, order)
    inside = np.ones(len(points), np.bool_)
    for back in range(1, order):
        inside[bounds[1:] - back] = False
    return hashes, inside[: len(hashes)]


def _hash_spelt(grams: list[tuple[int, ...]], order: int) -> np.ndarray:
    points = np.array(grams, np.uint64).reshape(len(grams), order).ravel()
    return wordhash.runs(points, order)[::order] if len(grams) else np.empty(0, np.uint64)


def build(counts: dict[str, dict[str, int]], order: int = ORDER) -> CharModel:
    """Models out of the counts of top n-grams per language."""
    languages = sorted(counts)
    grams = sorted({tuple(map(ord, g)) for by in counts.values() for g in by})
    place = {g: i for i, g in enumerate(grams)}
    count = np.zeros((len(grams), len(languages)))
    for j, lang in enumerate(languages):
        for gram, n in counts[lang].items():
            count[place[tuple(map(ord, gram))], j] = n
    levels = [(grams, count)]
    for k in range(order - 1, 0, -1):
        upper, upper_count = levels[0]
        lower = sorted({g[1:] for g in upper})
        place = {g: i for i, g in enumerate(lower)}
        before = np.zeros((len(lower), len(languages)))
        np.add.at(before, [place[g[1:]] for g in upper], upper_count > 0)
        levels.insert(0, (lower, before))
    model = CharModel(languages, [], [])
    lower_place: dict[tuple, int] = {}
    lower_prob = np.full((1, len(languages)), 1.0 / (len(levels[0][0]) + 1))
    for k, (grams, count) in enumerate(levels, start=1):
        contexts = sorted({g[:-1] for g in grams})
        place = {c: i for i, c in enumerate(contexts)}
        of = np.array([place[g[:-1]] for g in grams], np.int64)
        total = np.zeros((len(contexts), len(languages)))
        kinds = np.zeros_like(total)
        np.add.at(total, of, count)
        np.add.at(kinds, of, count > 0)
        one, two = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
        discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.9)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = lower_prob[[lower_place[g[1:]] for g in grams]] if k > 1 else lower_prob
        prob = np.maximum(count - discount, 0) / np.maximum(total[of], 1) + weight[of] * below
        hashes = _hash_spelt(grams, k)
        order_ = np.argsort(hashes)
        model.grams.append((hashes[order_], np.log(prob[order_]).astype(np.float32)))
        if k > 1:
            hashes = _hash_spelt(contexts, k - 1)
            order_ = np.argsort(hashes)
            model.contexts.append((hashes[order_], np.log(weight[order_]).astype(np.float32)))
        else:
            model.unseen = np.log(weight[0] * lower_prob[0]).astype(np.float32)
        lower_place = {g: i for i, g in enumerate(grams)}
        lower_prob = prob
    model.index()
    return model


def log_probabilities(model: CharModel, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probability in each language of the characters at ``ends``, from what stands before."""
    order = len(model.grams)
    out = np.zeros((len(ends), len(model.languages)), np.float32)
    left = np.arange(len(ends))
    for k in range(order, 0, -1):
        hashes = wordhash.runs(points, k)
        at = model.find[k - 1].find(hashes[ends[left] - k + 1])
        known = at >= 0
        out[left[known]] += model.grams[k - 1][1][at[known]]
        left = left[~known]
        if not len(left):
            return out
        if k == 1:
            out[left] += model.unseen
            return out
        at = model.find_context[k - 2].find(wordhash.runs(points, k - 1)[ends[left] - k + 1])
        met = at >= 0
        out[left[met]] += model.contexts[k - 2][1][at[met]]
    return out


def cross_entropies(model: CharModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language the cross-entropy in nats per character; and the characters."""
    pad = len(model.grams) - 1
    sums, sizes = [], []
    for begin, end in wordhash.batches(texts):
        points, bounds = wordhash.letter_stream(texts[begin:end], pad)
        inside = np.ones(len(points), np.bool_)
        for i in range(pad):
            inside[bounds[:-1] + i] = False
        prob = log_probabilities(model, points, np.flatnonzero(inside))
        first = bounds[:-1] - pad * np.arange(len(bounds) - 1)
        sums.append(np.add.reduceat(prob, first, axis=0, dtype=np.float64))
        sizes.append(np.diff(bounds) - pad)
    size = np.concatenate(sizes)
    return -np.concatenate(sums) / size[:, None], size


def judge(model: CharModel, texts: list[str]):
    """Per text the language, its share, its cross-entropy, and whether it is rejected."""
    entropy, size = cross_entropies(model, texts)
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(best)), best]
    odds = np.exp(-np.minimum(size, 50)[:, None] * (entropy - low[:, None])).sum(axis=1)
    bare = size < 2
    names = np.array(model.languages, object)[best]
    limit = model.limit[best] if model.limit is not None else np.inf
    names[bare] = UNKNOWN
    rejected = bare | (low > limit + SHORT / np.sqrt(size))
    return names, np.where(bare, 0.0, 1 / odds), low, rejected


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            if not texts:
                continue
            names, share, low, rejected = judge(shared.value, texts)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array(names, pa.string()), pa.array(share), pa.array(low), pa.array(rejected)],
                [batch.schema.names[i] for i in keep]
                + ["lang_pred", "score", "cross_entropy", "rejected"],
            )

    return run


def train(labelled: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, order: int = ORDER):
    """A broadcast model from ``labelled (doc_id, text, lang)``; None if no row has a language.

    About ``texts_per_language`` whole texts of each language are drawn by a hash of doc_id
    and text length, so their number, and with it the model, is bounded; half as many other
    texts set the limits. A language whose drawn texts all fall among these is learned from
    them, and its limit stays open.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    labelled = labelled.where("lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    wanted = 1.5 * texts_per_language
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, wanted / n))])
    mark = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = labelled.withColumn("_mark", mark / share[F.col("lang")]).where("_mark < 1")
    learn, rest = drawn.where("_mark < 2.0 / 3"), drawn.where("_mark >= 2.0 / 3")
    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}

    def count(texts: DataFrame) -> None:
        rows = (
            texts.select("lang", "text")
            .mapInArrow(_grams(order), "lang string, gram string, n bigint")
            .groupBy("lang", "gram")
            .agg(F.sum("n").alias("n"))
            .toPandas()
        )
        for lang, gram, n in zip(rows["lang"], rows["gram"], rows["n"].tolist(), strict=True):
            counts[lang][gram] = n

    count(learn)
    if few := [k for k, v in counts.items() if not v]:
        count(rest.where(F.col("lang").isin(few)))
        rest = rest.where(~F.col("lang").isin(few))
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return None
    model = build(counts, order)
    context = spark.sparkContext
    found = (
        rest.select("lang", "text")
        .mapInArrow(
            _predict(context.broadcast(_bare(model))),
            "lang string, lang_pred string, score double, cross_entropy double, rejected boolean",
        )
        .where("lang = lang_pred")
        .groupBy("lang")
        .agg(F.percentile("cross_entropy", 1 - REJECTED_SHARE).alias("limit"))
        .collect()
    )
    limit = {r["lang"]: r["limit"] for r in found}
    model.limit = np.array([limit.get(k, np.inf) + MARGIN for k in model.languages])
    return context.broadcast(model)


def _bare(model: CharModel) -> CharModel:
    model.limit = None
    return model


def known_only(docs: DataFrame, shared) -> DataFrame:
    """Rows of ``docs`` that ``identify`` would not reject, with all their columns."""
    if shared is None:
        return docs.where(F.lit(False))
    return keep_rows(docs, lambda texts: ~judge(shared.value, texts)[3])


def identify(docs: DataFrame, shared) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for each row of ``docs``.

    ``und`` (score 0, rejected) for null, empty and letterless texts, and for every text if
    nothing could be learned. Ties go to the language first in order. ``score`` is the share
    of the winning language among all at the text's first 50 characters' worth of evidence.
    Repeated rows are judged alike; columns beside doc_id and text are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean"
    if shared is None:
        return docs.select(
            "doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"),
        )
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), schema)
