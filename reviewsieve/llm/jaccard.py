"""Similarity join on word n-grams: MinHash bands find candidates, full sets decide.

1. Texts with the same set of shingles form a class; its least (doc_id, hash of text)
   stands for it, so texts that share a doc_id are told apart.
2. Each class gets ``BANDS`` bucket hashes of ``ROWS`` MinHash values each. At Jaccard
   similarity s two classes share a bucket with probability 1 - (1 - s^ROWS)^BANDS:
   0.9998 at the threshold 0.8, 0.03 at 0.4.
3. Every member of a bucket is tied to the bucket's least class. The components of these
   ties are the candidate families: whatever shares a bucket is in one family.
4. Families are compared on their full shingle sets, in blocks of at most ``BLOCK``
   classes. A block pair returns counts and a spanning forest of its links, one row per
   class and never pairs, so a large family costs time but no rows and no task beyond two
   blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm import wordhash
from reviewsieve.llm.components import components
from reviewsieve.llm.frames import bounded_batches, texts_of, written
from reviewsieve.session import broadcast_if_small

WORDS = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 8
BLOCK = 512
# Values of a dense slice while two blocks are compared.
DENSE = 8_000_000
_CHUNK = 2048


def band_hashes(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band of a set of 64-bit shingle hashes."""
    seeds = wordhash.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    flip = (seeds[: bands * rows] >> np.uint64(32)).astype(np.uint32)
    factor = (seeds[bands * rows :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), _CHUNK):
        values = short[i : i + _CHUNK, None] ^ flip
        values *= factor
        np.minimum(least, values.min(axis=0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in least.reshape(bands, rows).T:
            out = wordhash.mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, buckets, known = [], [], {}
            for shingles in wordhash.shingle_sets(texts_of(batch.column("text")), words):
                if not len(shingles):
                    digests.append(None)
                    buckets.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                if digest not in known:
                    known[digest] = band_hashes(shingles, bands, rows).tobytes()
                digests.append(digest)
                buckets.append(known[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("said"), pa.array(digests, pa.binary()),
                 pa.array(buckets, pa.binary())],
                ["doc_id", "said", "digest", "buckets"],
            )

    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [np.frombuffer(b, np.int64) for b in batch.column("buckets").to_pylist()]
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        if len(hashes):
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(owner)), pa.array(np.concatenate(hashes))],
                ["node", "bucket"],
            )


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays; ``right`` None: with themselves.

    Only values that occur at least twice can be shared; they become the columns of dense
    0/1 slices whose product counts them.
    """
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = count[column] > 1
    renumber = np.cumsum(count > 1) - 1
    owner, column = owner[twice], renumber[column[twice]]
    width = int((count > 1).sum())
    n = len(left)
    out = np.zeros((n, len(right) if right is not None else n), np.float32)
    step = max(1, DENSE // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, width, step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((len(sets), min(step, width - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[:n] @ (dense[n:] if right is not None else dense).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs have Jaccard similarity of at least ``threshold``, exactly."""
    shared = shared_counts(left, right).astype(np.float64)
    a = np.array([len(s) for s in left], np.float64)
    b = a if right is None else np.array([len(s) for s in right], np.float64)
    union = a[:, None] + b[None, :] - shared
    out = shared >= threshold * union - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def local_roots(links: np.ndarray) -> np.ndarray:
    """Per row of a symmetric link matrix the least row that can be reached over links."""
    root = np.full(len(links), -1)
    for i in range(len(links)):
        todo = np.array([i]) if root[i] < 0 else ()
        while len(todo):
            root[todo] = i
            todo = np.flatnonzero(links[todo].any(axis=0) & (root < 0))
    return root


def _tally(nodes: np.ndarray, copies: np.ndarray, links: np.ndarray) -> list[tuple]:
    """Per linked class: documents linked to it, and the class that is its local root.

    Together the roots are a spanning forest of all links of the unit.
    """
    root = local_roots(links)
    return [
        (nodes[i], int(copies[links[i]].sum()), nodes[root[i]])
        for i in np.flatnonzero(links.any(axis=1))
    ]


def _compare(threshold: float):
    """One task unit: a bin of small families, or two blocks of a large one."""

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        unit = unit.drop_duplicates(["node", "side"])
        for _, family in unit.groupby("family", sort=False):
            sides = []
            for side in (0, 1):
                part = family[family["side"] == side].sort_values("node")
                sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
                sides.append((part["node"].to_numpy(), part["copies"].to_numpy(), sets))
            (na, ca, sa), (nb, cb, sb) = sides
            if len(sa) > 1 and not sb:
                rows += _tally(na, ca, linked(sa, None, threshold))
            elif sa and sb:
                links = np.zeros((len(na) + len(nb),) * 2, np.bool_)
                links[: len(na), len(na) :] = linked(sa, sb, threshold)
                links |= links.T
                rows += _tally(np.append(na, nb), np.append(ca, cb), links)
        return pd.DataFrame(rows, columns=["node", "links", "root"])

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = wordhash.shingle_sets(texts_of(batch.column("text")), words)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array([s.tobytes() for s in sets], pa.binary())],
                [batch.schema.names[i] for i in keep] + ["shingles"],
            )

    return run


def text_key() -> Column:
    """A hash of the text; beside doc_id it tells texts that share a doc_id apart."""
    return F.xxhash64("text")


def _node() -> Column:
    """doc_id and hash of text as bytes that sort like the two numbers."""
    doc_id = F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    return F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in (doc_id, F.col("said"))])


def _doc_id(node: Column) -> Column:
    number = F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint")
    return number.bitwiseXOR(F.lit(-(2**63)))


def similarity_classes(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Near copies among ``docs (doc_id, text)``: ``doc_id, class_id, n_copies, n_links``.

    One row per input row. ``n_copies``: documents with the same shingle set, itself
    included; ``n_links``: other documents with Jaccard similarity >= ``threshold`` on
    lower-case shingles of ``words`` words, copies included; ``class_id``: the least doc_id
    that can be reached over links. Shorter texts are one shingle. Texts without a word
    (null, empty, signs only) and rows without a doc_id are linked to nothing: n_copies 1,
    n_links 0, their own doc_id as class. A repeated row counts as a copy. Rows that
    share a doc_id but not their text are classed by their own texts. Other columns are
    ignored. An empty table gives an empty result.
    """
    signed, state = _classed(docs, words, threshold, bands, rows)
    state = state.withColumn("class_id", _doc_id(F.col("label"))).drop("node", "label")
    return (
        signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(written(state, "state"), "digest", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def later_texts(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, said, first`` of texts in ``docs`` that are not the only one of their group.

    ``said`` is the ``text_key`` of the row; of each group of near copies the least
    (doc_id, said) is ``first``. A first text is listed only if rows repeat it. Rows without
    a doc_id are in no group; of texts without a word only equal ones with one doc_id are.
    """
    signed, state = _classed(docs, words, threshold, bands, rows)
    own = signed.where("doc_id is not null").select("doc_id", "said", "digest", _node().alias("own"))
    leads = written(state.where("node = label").select("digest", "node"), "leads")
    return (
        own.join(leads, "digest", "left")
        .groupBy("doc_id", "said")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.bool_or(F.col("digest").isNull() | F.coalesce(F.col("own") == F.col("node"), F.lit(False)))
            .alias("first"),
        )
        .where("rows > 1 or not first")
        .select("doc_id", "said", "first")
    )


def _classed(
    docs: DataFrame, words: int, threshold: float, bands: int, rows: int
) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id, said, digest``; per digest its ``node, label, n_copies, n_links``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", text_key().alias("said"))
    signed = written(
        docs.mapInArrow(
            _signatures(words, bands, rows),
            "doc_id bigint, said bigint, digest binary, buckets binary",
        ),
        "signed",
    )
    classes = written(
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "said")).alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.any_value("buckets").alias("buckets"),
        )
        .select("digest", "least.*", "copies", "buckets")
        .withColumn("node", _node()),
        "classes",
    )
    hashed = classes.select("node", "buckets").mapInArrow(
        _bucket_rows, "node binary, bucket bigint"
    )
    shared = (
        hashed.groupBy("bucket")
        .agg(F.min("node").alias("a"), F.max("node").alias("b"))
        .where("a < b")
        .select("bucket", "a")
    )
    ties = hashed.join(shared, "bucket").where("node > a").select("a", F.col("node").alias("b"))
    families = written(
        components(ties.distinct()).select("node", F.col("label").alias("family")), "families"
    )
    found = written(_links(docs, classes, families, words, threshold), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    state = (
        classes.select("digest", "node", "copies")
        .join(counted, "node", "left")
        .join(labels, "node", "left")
        .select(
            "digest",
            "node",
            F.coalesce("label", "node").alias("label"),
            F.col("copies").alias("n_copies"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return signed, state


def _links(
    docs: DataFrame, classes: DataFrame, families: DataFrame, words: int, threshold: float
) -> DataFrame:
    """``node, links, root`` per class and task unit; units are sized, families never whole."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    members = written(
        families.join(sizes, "family")
        .join(classes.select("node", "doc_id", "said", "copies"), "node")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")),
        "members",
    )
    bins = max(1, math.ceil(members.count() / BLOCK))
    texts = docs.join(broadcast_if_small(members), ["doc_id", "said"])
    sets = texts.select("node", "family", "blocks", "copies", "text").mapInArrow(
        _shingles(words), "node binary, family binary, blocks int, copies bigint, shingles binary"
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (
        sets.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
        .withColumn(
            "unit",
            F.when(F.col("blocks") > 1, F.xxhash64("family", "low", "high")).otherwise(
                F.pmod(F.xxhash64("family"), F.lit(bins))
            ),
        )
    )
    return (
        placed.select("unit", "low", "high", "family", "side", "node", "copies", "shingles")
        .groupBy("unit", "low", "high")
        .applyInPandas(_compare(threshold), "node binary, links bigint, root binary")
    )
