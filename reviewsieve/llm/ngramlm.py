"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept in files.

Counting: each task turns its texts into pairs of neighbouring tokens, sums equal pairs and
sends them on in arrays by shard. A shard merges its arrays, writes its pairs as a sorted
array of 64-bit hashes with counts, and sends what the pairs say about single tokens on to
the token shards, which write sorted arrays too. A pair's shard is taken from its first
token and three bits of the second, so a frequent first token is spread over shards.
Only counts of counts and totals reach the driver.

Scoring: tasks map the files into memory and look their tokens up by binary search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm import wordhash
from reviewsieve.llm.files import Folder, put
from reviewsieve.llm.frames import bounded_batches, shared_folder, texts_of, written

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
# Tokens whose pairs a task sums up before it sends them.
CHUNK_TOKENS = 2_000_000
TOKEN_FIELDS = ("total", "n1", "n2", "n3", "tokens", "before")


def lower_ascii(texts: list[str]) -> list[str]:
    """A to Z in lower case, all else as it is."""
    table = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    return [t.lower() if t.isascii() else t.translate(table) for t in texts]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words and one end per text), of those before, and text bounds."""
    found = wordhash.words(lower_ascii(texts), wordhash.not_space)
    n = len(texts)
    bounds = found.first + np.arange(n + 1)
    token = np.full(len(found.hash) + n, END, np.uint64)
    inside = np.ones(len(token), np.bool_)
    inside[bounds[1:] - 1] = False
    token[inside] = found.hash
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[bounds[:-1]] = START
    return token, before, bounds


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wordhash.mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def pair_shard(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = wordhash.mix(first + (second >> np.uint64(61)))
    return (spread % np.uint64(shards)).astype(np.uint16)


def token_shard(token: np.ndarray, shards: int) -> np.ndarray:
    return ((token >> np.uint64(20)) % np.uint64(shards)).astype(np.uint16)


def _bounds(sorted_shards: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(sorted_shards, np.arange(shards + 1))


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values), 1)


def _pairs(shards: int):
    """Texts to arrays of pairs by shard: first tokens once, then their second tokens."""

    def emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        first = np.concatenate([p[0] for p in parts])
        second = np.concatenate([p[1] for p in parts])
        order = np.argsort(pair_hash(first, second))
        first, second = first[order], second[order]
        new = np.ones(len(first), np.bool_)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(first))).astype(np.uint32)
        first, second = first[at], second[at]
        order = np.argsort(first, kind="stable")
        order = order[np.argsort(pair_shard(first[order], second[order], shards), kind="stable")]
        first, second, count = first[order], second[order], count[order]
        bounds = _bounds(pair_shard(first, second, shards), shards)
        rows = []
        for shard, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if a < b:
                begin = np.flatnonzero(np.append(True, first[a + 1 : b] != first[a : b - 1]))
                runs = np.diff(np.append(begin, b - a)).astype(np.uint32)
                rows.append(
                    (shard, first[a:b][begin].tobytes(), _pack(runs), second[a:b].tobytes(),
                     _pack(count[a:b]))
                )
        kinds = [pa.int32(), *[pa.binary()] * 4]
        names = ["shard", "first", "runs", "second", "count"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for begin, end in wordhash.batches(texts):
                token, before, _ = tokens(texts[begin:end])
                parts.append((before, token))
                held += len(token)
                if held >= CHUNK_TOKENS:
                    yield emit(parts)
                    parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and the sums of each column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    summed = [np.add.reduceat(c[order], at) if len(at) else c for c in columns]
    return keys[at], summed


def _merge_pairs(folder: str, token_shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        first = np.concatenate(
            [
                np.repeat(np.frombuffer(f, np.uint64), np.frombuffer(zlib.decompress(r), np.uint32))
                for f, r in zip(group["first"], group["runs"], strict=True)
            ]
        )
        second = np.concatenate([np.frombuffer(s, np.uint64) for s in group["second"]])
        count = np.concatenate(
            [np.frombuffer(zlib.decompress(c), np.uint32) for c in group["count"]]
        ).astype(np.int64)
        hashes = pair_hash(first, second)
        order = np.argsort(hashes)
        hashes, first, second, count = (x[order] for x in (hashes, first, second, count))
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        count = np.add.reduceat(count, at)
        hashes, first, second = hashes[at], first[at], second[at]
        put(folder, f"pair-{shard}.hash", hashes)
        put(folder, f"pair-{shard}.count", np.minimum(count, 2**32 - 1).astype(np.uint32))
        one = np.ones(len(count), np.int64)
        none = np.zeros(len(count), np.int64)
        keys, sums = _sums(
            np.concatenate((first, second)),
            [
                np.concatenate((count, none)),
                *[np.concatenate((m.astype(np.int64), none)) for m in (count == 1, count == 2, count > 2)],
                np.concatenate((none, count)),
                np.concatenate((none, one)),
            ],
        )
        order = np.argsort(token_shard(keys, token_shards), kind="stable")
        keys, sums = keys[order], [s[order] for s in sums]
        bounds = _bounds(token_shard(keys, token_shards), token_shards)
        rows = [
            (t, keys[a:b].tobytes(), *[_pack(s[a:b]) for s in sums])
            for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
            if a < b
        ]
        met = np.bincount(np.minimum(count, 5), minlength=6)[1:5].astype(np.int64)
        rows.append((-1, met.tobytes(), *[b""] * len(TOKEN_FIELDS)))
        return pd.DataFrame(rows, columns=["shard", "keys", *TOKEN_FIELDS])

    return run


def _merge_tokens(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        names = ["n", "distinct", "m1", "m2", "m3", "m4", "m3up", "before"]
        if shard < 0:
            met = sum(np.frombuffer(k, np.int64) for k in group["keys"])
            return pd.DataFrame([(shard, 0, 0, *map(int, met), 0, 0)], columns=["shard", *names])
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in group["keys"]])
        columns = [
            np.concatenate([np.frombuffer(zlib.decompress(c), np.int64) for c in group[f]])
            for f in TOKEN_FIELDS
        ]
        keys, sums = _sums(keys, columns)
        put(folder, f"token-{shard}.hash", keys)
        for name, values in zip(TOKEN_FIELDS, sums, strict=True):
            put(folder, f"token-{shard}.{name}", values)
        counts, before = sums[4], sums[5]
        met = np.bincount(np.minimum(before, 5), minlength=6)
        row = (shard, int(counts.sum()), int((counts > 0).sum()), *map(int, met[1:5]),
               int((before > 2).sum()), int(before.sum()))
        return pd.DataFrame([row], columns=["shard", *names])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; what small counts leave open is an even discount."""
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.01), 0.99), min(max(d2, 0.01), 1.99), min(max(d3, 0.01), 2.99)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals. ``n``: training tokens, ``distinct``: different ones."""

    folder: str
    shards: int
    token_shards: int
    n: int
    distinct: int
    pair_discount: tuple[float, float, float]
    before_discount: tuple[float, float, float]
    before_total: int
    spare: float


def train(texts: DataFrame) -> Model:
    """Count ``texts (text)``. Shards follow ``spark.sql.shuffle.partitions``."""
    spark = texts.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark, "lm")
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    token_shards = max(4, shards // 8)
    blobs = ", ".join(f"{n} binary" for n in ("keys", *TOKEN_FIELDS))
    pairs = texts.select("text").mapInArrow(
        _pairs(shards), "shard int, first binary, runs binary, second binary, count binary"
    )
    about = written(
        pairs.groupBy("shard").applyInPandas(
            _merge_pairs(folder, token_shards), f"shard int, {blobs}"
        ),
        "tokens",
    )
    totals = about.groupBy("shard").applyInPandas(
        _merge_tokens(folder),
        "shard int, n long, distinct long, m1 long, m2 long, m3 long, m4 long, m3up long, before long",
    )
    rows = totals.collect()
    met = next((r for r in rows if r["shard"] < 0), None)
    rows = [r for r in rows if r["shard"] >= 0]
    total = lambda name: sum(r[name] for r in rows)
    pair_discount = discounts(met["m1"], met["m2"], met["m3"], met["m4"]) if met else (0.5,) * 3
    before = discounts(total("m1"), total("m2"), total("m3"), total("m4"))
    taken = before[0] * total("m1") + before[1] * total("m2") + before[2] * total("m3up")
    kinds = total("before")
    spare = (taken / kinds if kinds else 1.0) / (total("distinct") + 1)
    return Model(
        folder, shards, token_shards, total("n"), total("distinct"), pair_discount, before, kinds, spare
    )


def _discounted(count: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0.0, *by])[np.minimum(count, 3)]


class Lookup:
    """Reads a model's arrays for batches of tokens."""

    def __init__(self, model: Model):
        self.model = model
        self.files = Folder(model.folder)

    def _find(self, kind, shards, shard_of, keys, fields):
        """Values of ``fields`` per key (0 if unknown); each shard is asked in sorted order."""
        order = np.argsort(keys)
        order = order[np.argsort(shard_of[order], kind="stable")]
        bounds = _bounds(shard_of[order], shards)
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        for shard in np.flatnonzero(np.diff(bounds)).tolist():
            here = order[bounds[shard] : bounds[shard + 1]]
            held = self._array(f"{kind}-{shard}.hash", np.uint64)
            if not len(held):
                continue
            at = np.minimum(np.searchsorted(held, keys[here]), len(held) - 1)
            known = held[at] == keys[here]
            for values, (field, dtype) in zip(out, fields, strict=True):
                values[here[known]] = self._array(f"{kind}-{shard}.{field}", dtype)[at[known]]
        return out

    def _array(self, name: str, dtype) -> np.ndarray:
        try:
            return self.files.array(name, dtype)
        except FileNotFoundError:  # a shard without rows writes no file
            return np.empty(0, dtype)

    def pairs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        shards = self.model.shards
        of = pair_shard(before, token, shards)
        return self._find("pair", shards, of, pair_hash(before, token), [("count", np.uint32)])[0]

    def tokens(self, token: np.ndarray) -> list[np.ndarray]:
        shards = self.model.token_shards
        fields = [(f, np.int64) for f in TOKEN_FIELDS]
        return self._find("token", shards, token_shard(token, shards), token, fields)


def log_probabilities(lookup: Lookup, token: np.ndarray, before: np.ndarray):
    """log10 p(token | before), log10 of the base model, and the token's training count."""
    model = lookup.model
    unique, where = np.unique(np.concatenate((token, before)), return_inverse=True)
    total, n1, n2, n3, counts, kinds = lookup.tokens(unique)
    here, there = where[: len(token)], where[len(token) :]
    lower = _discounted(kinds, model.before_discount) / max(model.before_total, 1) + model.spare
    d1, d2, d3 = model.pair_discount
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / total, 1.0)
        pair = _discounted(lookup.pairs(before, token), model.pair_discount) / total[there]
    pair[total[there] == 0] = 0.0
    score = np.log10(pair + weight[there] * lower[here])
    base = np.log10((counts + 0.5) / (model.n + 0.5 * (model.distinct + 1)))
    return score, base[here], counts[here]


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            rows: list[np.ndarray] = []
            for begin, end in wordhash.batches(texts):
                token, before, bounds = tokens(texts[begin:end])
                score, base, count = log_probabilities(lookup, token, before)
                at = bounds[:-1]
                rows.append(
                    [np.diff(bounds), np.add.reduceat((count > 0).astype(np.int64), at),
                     np.add.reduceat(base, at), np.add.reduceat(score, at)]
                )
            if rows:
                columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in keep] + [pa.array(c) for c in columns],
                    [batch.schema.names[i] for i in keep]
                    + ["n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` per row.

    ``score``: log10 probability of the whole text with its end; ``base_score``: the same by
    add-one-half single token counts; ``perplexity``: 10 to the -score / n_tokens. A null or
    empty text is its end alone. Repeated rows and null doc_ids are scored like any other;
    columns beside doc_id and text are ignored. A model of no texts gives every token the
    same probability.
    """
    bounded_batches(docs.sparkSession)
    return (
        docs.select("doc_id", "text")
        .mapInArrow(
            _score(model),
            "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double",
        )
        .withColumn("train_tokens", F.lit(model.n).cast("long"))
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )
