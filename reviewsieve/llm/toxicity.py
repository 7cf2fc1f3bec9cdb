"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each n-gram that a text holds is a feature. Its naive Bayes log-count ratio says how much
more often toxic training texts hold it; the features with the clearest ratios are kept,
scaled by their ratio, and weighed by a logistic regression with a quadratic penalty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm import wordhash
from reviewsieve.llm.frames import bounded_batches, keep_rows, texts_of, written

SIZES = (3, 4, 5, 6)
BITS = 20
# About so many labelled texts are fitted on, whatever the size of the table.
TRAINING_TEXTS = 20_000
# Training texts whose n-grams a task counts together.
TASK_TEXTS = 2_500
FEATURES = 4096
SMOOTHING = 1.0
PENALTY = 1.0
THRESHOLD = 0.3


@dataclass
class Classifier:
    """``place``: feature of each hash bucket or -1; ``weight`` per feature; ``bias``."""

    place: np.ndarray
    weight: np.ndarray
    bias: float
    sizes: tuple[int, ...]


def _buckets(points: np.ndarray, size: int) -> np.ndarray:
    return (wordhash.runs(points, size) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(texts: list[str], sizes: tuple[int, ...], place: np.ndarray | None):
    """Distinct (text, feature) pairs of a batch; all buckets if no ``place`` is given."""
    points, bounds = wordhash.letter_stream(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    codes = []
    for size in sizes:
        buckets = _buckets(points, size)
        of = owner[: len(buckets)]
        inside = of == owner[size - 1 :]
        if place is not None:
            buckets = place[buckets]
            inside &= buckets >= 0
        codes.append((of[inside] << BITS) | buckets[inside])
    codes = np.unique(np.concatenate(codes))
    return codes >> BITS, codes & ((1 << BITS) - 1)


def _held(sizes: tuple[int, ...]):
    """How many toxic and other texts of a task hold each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for begin, end in wordhash.batches(texts, 200_000):
                text, bucket = _features(texts[begin:end], sizes, None)
                for label in (0, 1):
                    own = toxic[begin:end][text] == label
                    counts[label] += np.bincount(bucket[own], minlength=1 << BITS)
        used = np.flatnonzero(counts.any(axis=0))
        for part in np.array_split(used, max(1, len(used) // 100_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), *[pa.array(c[part]) for c in counts]],
                ["bucket", "other", "toxic"],
            )

    return run


def _chosen(shared):
    """Per training text its chosen features and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sizes = shared.value
        for batch in batches:
            texts = texts_of(batch.column("text"))
            features: list[bytes] = []
            for begin, end in wordhash.batches(texts):
                text, feature = _features(texts[begin:end], sizes, place)
                cuts = np.searchsorted(text, np.arange(1, end - begin))
                features += [f.astype(np.uint16).tobytes() for f in np.split(feature, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(features, pa.binary())],
                ["doc_id", "toxic", "features"],
            )

    return run


def fit_logistic(
    rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, labels: np.ndarray, penalty: float
) -> tuple[np.ndarray, float]:
    """Weights and bias of a penalised logistic regression on sparse ``scale``-valued features.

    Newton steps; each is solved by conjugate gradients. The loss is convex and the bias is
    not penalised.
    """
    n, k = len(labels), len(scale)
    beta = np.zeros(k + 1)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, (scale * v[:-1])[columns], n) + v[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(scale * np.bincount(columns, u[rows], k), u.sum())

    ridge = np.append(np.full(k, penalty), 1e-6)
    loss = lambda b: np.logaddexp(0, (1 - 2 * labels) * times(b)).sum() + (ridge * b * b).sum() / 2
    now = loss(beta)
    for _ in range(25):
        p = 1 / (1 + np.exp(-times(beta)))
        gradient = back(p - labels) + ridge * beta
        curve = np.maximum(p * (1 - p), 1e-9)
        step, rest = np.zeros_like(beta), -gradient
        move, size = rest.copy(), rest @ rest
        target = 1e-4 * size
        for _ in range(30):
            if size <= target or size == 0:
                break
            product = back(curve * times(move)) + ridge * move
            length = size / (move @ product)
            step += length * move
            rest -= length * product
            size, before = rest @ rest, size
            move = rest + size / before * move
        width = 1.0
        while width > 1e-4 and (then := loss(beta + width * step)) > now:
            width /= 2
        if width <= 1e-4 or now - then < 1e-6 * max(now, 1):
            break
        beta, now = beta + width * step, then
    return beta[:-1], float(beta[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    training_texts: int = TRAINING_TEXTS,
    features: int = FEATURES,
    sizes: tuple[int, ...] = SIZES,
    penalty: float = PENALTY,
):
    """A broadcast classifier from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``.

    About ``training_texts`` labelled rows are drawn by a hash of doc_id; that bounds what
    is broadcast and what the driver fits. A doc_id labelled twice is toxic if any label is;
    null labels do not count. None if no labelled text is there; a sample of one kind gives
    a constant score.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    total = known.count()
    if not total:
        return None
    mark = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.where(mark < min(1.0, training_texts / total))
    # The sample is bounded, so its texts may move: a few tasks send fewer counts than many.
    parts = max(1, math.ceil(min(total, training_texts) / TASK_TEXTS))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = written(sample.repartition(parts), "sample")
    held = (
        sample.select("text", "toxic")
        .mapInArrow(_held(sizes), "bucket int, other bigint, toxic bigint")
        .groupBy("bucket")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    )
    sides = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a = SMOOTHING
    ratio = F.log((F.col("toxic") + a) / (sides.get(1, 0) + 2 * a)) - F.log(
        (F.col("other") + a) / (sides.get(0, 0) + 2 * a)
    )
    clear = F.abs(ratio) / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    best = (
        held.select("bucket", ratio.alias("ratio"), clear.alias("clear"))
        .orderBy(F.desc("clear"), "bucket")
        .limit(features)
        .collect()
    )
    place = np.full(1 << BITS, -1, np.int32)
    place[[r["bucket"] for r in best]] = np.arange(len(best))
    scale = np.array([r["ratio"] for r in best])
    rows = (
        sample.mapInArrow(
            _chosen(spark.sparkContext.broadcast((place, sizes))),
            "doc_id bigint, toxic int, features binary",
        )
        .toPandas()
        .sort_values("doc_id")
    )
    if not len(rows):
        return None
    toxic, found = rows["toxic"].to_numpy(float), rows["features"].to_list()
    del rows
    owner = np.repeat(np.arange(len(found)), [len(f) // 2 for f in found])
    column = np.frombuffer(b"".join(found), np.uint16).astype(np.int64)
    del found
    weight, bias = fit_logistic(owner, column, scale, toxic, penalty)
    return spark.sparkContext.broadcast(Classifier(place, weight * scale, bias, sizes))


def probabilities(model: Classifier, texts: list[str]) -> np.ndarray:
    out = np.empty(len(texts))
    for begin, end in wordhash.batches(texts):
        text, feature = _features(texts[begin:end], model.sizes, model.place)
        sums = np.bincount(text, model.weight[feature], end - begin) + model.bias
        out[begin:end] = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
    return out


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = probabilities(shared.value, texts_of(batch.column("text")))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(found)],
                [batch.schema.names[i] for i in keep] + ["score"],
            )

    return run


def clean_only(docs: DataFrame, shared, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that ``score`` would predict 0 for, with all their columns."""
    if shared is None:
        return docs
    return keep_rows(docs, lambda texts: probabilities(shared.value, texts) < threshold)


def score(docs: DataFrame, shared, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``, from whole texts.

    Null, empty and letterless texts get the score of a text without features. Without a
    classifier every score is 0. Repeated rows are judged alike; columns beside doc_id and
    text are ignored.
    """
    bounded_batches(docs.sparkSession)
    if shared is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = docs.select("doc_id", "text").mapInArrow(
            _scores(shared), "doc_id bigint, score double"
        )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
