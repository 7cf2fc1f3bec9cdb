"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

Every item becomes weighted word shingles and a 64-bit SimHash. A document is read in windows
of the item's number of words. Windows that share no shingle with an item of their size have
similarity 0 and need no fingerprint; all others get one. Fingerprints within ``RADIUS`` bits
are found by multi-index blocks: of two such fingerprints at least one of ``PARTS`` parts
differs by at most RADIUS // PARTS bits, so an item is filed under every value that near to
each of its parts. Whatever is found is verified by exact weighted-shingle similarity.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm import wordhash
from reviewsieve.llm.frames import bounded_batches, keep_rows, texts_of, written

WORDS = 5
THRESHOLD = 0.8
RADIUS = 20
PARTS = 8
BITS = 64
# Items that are indexed together; more are taken in several passes over the documents.
ITEM_BLOCK = 20_000
_FILTER_BITS = 20


@dataclass
class Items:
    """The items of one block: shingle sets by item, and the index by window size."""

    ids: list[int]
    size: np.ndarray
    shingles: list[dict[int, int]]
    prints: np.ndarray
    weight: dict[int, float]
    usual: float
    #: Sizes of the items that hold a shingle.
    sizes_of: dict[int, tuple[int, ...]]
    #: Per size: per part, the items filed under each value.
    parts: dict[int, list[dict[int, list[int]]]]
    seen: np.ndarray = field(repr=False)


def simhash(shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Running sums of +weight or -weight for every bit of the shingles, one row in front."""
    bits = (shingles[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    signs = np.where(bits == 1, weight[:, None], -weight[:, None])
    return np.concatenate((np.zeros((1, BITS)), np.cumsum(signs, axis=0)))


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Sums per bit to 64-bit numbers. Rounding noise of equal sums counts as zero."""
    ones = (sums > 1e-9).astype(np.uint64)
    return (ones << np.arange(BITS, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


def near_values(value: int, width: int, radius: int) -> Iterator[int]:
    """All ``width``-bit values that differ from ``value`` in at most ``radius`` bits."""
    for n in range(radius + 1):
        for flips in itertools.combinations(range(width), n):
            yield value ^ sum(1 << f for f in flips)


def _part(prints: np.ndarray, part: int, parts: int) -> np.ndarray:
    width = BITS // parts
    return (prints >> np.uint64(part * width)) & np.uint64((1 << width) - 1)


def item_shingles(text: str, words: int) -> tuple[np.ndarray, int]:
    """Shingle hashes in order, and the number of words; a short text is one shingle."""
    found = wordhash.words([text.lower()]).hash
    n = len(found)
    return (wordhash.runs(found, min(words, n)) if n else np.empty(0, np.uint64)), n


def index_items(
    items: list[tuple[int, str]],
    words: int = WORDS,
    radius: int = RADIUS,
    parts: int = PARTS,
    every: tuple[int, dict[int, int]] | None = None,
) -> Items:
    """Index of one block. A shingle weighs the less, the more items hold it.

    ``every``: number of all items, and of those that hold a shingle that several hold;
    None if the block is all there is.
    """
    ids, sizes, shingles = [], [], []
    for item_id, text in items:
        found, n = item_shingles(text, words)
        if n:
            ids.append(item_id)
            sizes.append(n)
            shingles.append(found)
    held = Counter(s for found in shingles for s in set(found.tolist()))
    total, several = every or (len(ids), held)
    usual = float(np.log1p(total))
    weight = {s: float(np.log1p(total / n)) for s, n in several.items()}
    prints = np.zeros(len(ids), np.uint64)
    sizes_of: dict[int, set[int]] = {}
    filed: dict[int, list[dict[int, list[int]]]] = {}
    seen = np.zeros(1 << _FILTER_BITS, np.bool_)
    width = BITS // parts
    for i, found in enumerate(shingles):
        weights = np.array([weight.get(s, usual) for s in found.tolist()])
        prints[i] = fingerprint(simhash(found, weights)[-1])
        seen[(found & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        for s in set(found.tolist()):
            sizes_of.setdefault(s, set()).add(sizes[i])
        tables = filed.setdefault(sizes[i], [{} for _ in range(parts)])
        for part in range(parts):
            value = int(_part(prints[i : i + 1], part, parts)[0])
            for near in near_values(value, width, radius // parts):
                tables[part].setdefault(near, []).append(i)
    return Items(
        ids,
        np.array(sizes, np.int64),
        [dict(Counter(f.tolist())) for f in shingles],
        prints,
        weight,
        usual,
        {s: tuple(sorted(v)) for s, v in sizes_of.items()},
        filed,
        seen,
    )


def within_radius(index: Items, size: int, prints: np.ndarray, radius: int, parts: int):
    """``(window, item)`` pairs whose fingerprints differ in at most ``radius`` bits."""
    tables = index.parts[size]
    found: set[tuple[int, int]] = set()
    for part, table in enumerate(tables):
        values = _part(prints, part, parts).tolist()
        for window, value in enumerate(values):
            found.update((window, item) for item in table.get(value, ()))
    return [
        (window, item)
        for window, item in sorted(found)
        if (int(prints[window]) ^ int(index.prints[item])).bit_count() <= radius
    ]


def similarity(a: dict[int, int], b: dict[int, int], weight: dict[int, float], usual: float):
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(min(n, b[s]) * weight.get(s, usual) for s, n in a.items() if s in b)
    total = lambda bag: sum(n * weight.get(s, usual) for s, n in bag.items())
    union = total(a) + total(b) - both
    return both / union if union else 0.0


def _windows(index: Items, hits: np.ndarray, shingles: np.ndarray, n: int, words: int):
    """Starts of windows by item size that hold a shingle of an item of that size."""
    starts: dict[int, set[int]] = {}
    for at in hits.tolist():
        for size in index.sizes_of.get(int(shingles[at]), ()):
            last = max(0, n - size)
            low, high = max(0, at - max(size - words, 0)), min(at, last)
            starts.setdefault(size, set()).update(range(min(low, last), high + 1))
    return starts


def matches(
    index: Items,
    hashes: np.ndarray,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    parts: int = PARTS,
) -> list[tuple[int, int, int, float]]:
    """``(item id, first word, words, similarity)`` of each item's best window in a text."""
    best: dict[int, tuple[float, int, int]] = {}
    n = len(hashes)
    for length in sorted({min(words, n), *(int(s) for s in index.size if s < words)}):
        if not 0 < length <= n:
            continue
        shingles = wordhash.runs(hashes, length)
        mask = np.uint64((1 << _FILTER_BITS) - 1)
        hits = np.flatnonzero(index.seen[(shingles & mask).astype(np.int64)])
        hits = hits[[int(s) in index.sizes_of for s in shingles[hits].tolist()]] if len(hits) else hits
        if not len(hits):
            continue
        for size, found in _windows(index, hits, shingles, n, length).items():
            if (length < words) != (size < words or n < words):
                continue
            starts = np.array(sorted(found), np.int64)
            span = min(size, n) - length + 1
            if span < 1:
                continue
            low, high = int(starts[0]), int(starts[-1]) + span
            own = shingles[low:high]
            weights = np.array([index.weight.get(s, index.usual) for s in own.tolist()])
            sums = simhash(own, weights)
            prints = fingerprint(sums[starts - low + span] - sums[starts - low])
            for window, item in within_radius(index, size, prints, radius, parts):
                start = int(starts[window])
                bag = Counter(shingles[start : start + span].tolist())
                near = similarity(bag, index.shingles[item], index.weight, index.usual)
                if near >= threshold - 1e-12 and (
                    item not in best or (near, -start) > (best[item][0], -best[item][1])
                ):
                    best[item] = (near, start, min(size, n))
    return [
        (index.ids[item], start, size, near)
        for item, (near, start, size) in sorted(best.items())
    ]


def search(
    index: Items, texts: list[str], words: int, threshold: float, radius: int, parts: int
) -> Iterator[tuple[int, tuple]]:
    """Place of a text in the list, and each of its matches."""
    for begin, end in wordhash.batches(texts):
        found = wordhash.words([t.lower() for t in texts[begin:end]])
        for i in _suspects(index, found, words):
            own = found.hash[found.first[i] : found.first[i + 1]]
            for match in matches(index, own, words, threshold, radius, parts):
                yield begin + i, match


def _search(shared, words: int, threshold: float, radius: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            found = search(index, texts_of(batch.column("text")), words, threshold, radius, parts)
            rows = [(docs[i], *match) for i, match in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "first_word", "n_words", "similarity"],
            )

    return run


def _suspects(index: Items, found: wordhash.Words, words: int) -> list[int]:
    """Texts that may hold a shingle of an item, by one look at the whole batch."""
    mask = np.uint64((1 << _FILTER_BITS) - 1)
    counts = np.diff(found.first)
    short = (counts > 0) & (counts < words)
    marked = np.zeros(len(counts), np.bool_)
    for length in sorted({words, *(int(s) for s in index.size if s < words)}):
        shingles = wordhash.runs(found.hash, length)
        hit = np.flatnonzero(index.seen[(shingles & mask).astype(np.int64)])
        text = np.searchsorted(found.first, hit, "right") - 1
        inside = hit + length <= found.first[text + 1]
        marked[text[inside]] = True
    return np.flatnonzero(marked | short).tolist()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    parts: int = PARTS,
) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity``: items found in whole documents.

    One row per row of ``docs (doc_id, text)`` and item of ``items (item_id, text)`` that has a
    window of similarity >= ``threshold``; the best window, the first of equal ones. Words are
    compared in lower case, signs are left out. A text shorter than the item is one window.
    Items and texts without a word (null, empty) match nothing; an item shorter than a shingle
    is one shingle. Repeated items are found each, repeated documents alike. Rows with a null
    id keep it. Other columns are ignored. At similarity 0.8 the fingerprints of window and
    item lie within ``radius`` of 64 bits with probability above 0.999.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id bigint, item_id bigint, first_word bigint, n_words bigint, similarity double"
    out = None
    for block, every in _item_blocks(items, words):
        index = spark.sparkContext.broadcast(index_items(block, words, radius, parts, every))
        found = docs.select("doc_id", "text").mapInArrow(
            _search(index, words, threshold, radius, parts), schema
        )
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean_only(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    parts: int = PARTS,
) -> DataFrame:
    """Rows of ``docs`` in which ``contaminated`` finds nothing, with all their columns."""
    for block, every in _item_blocks(items, words):
        index = docs.sparkSession.sparkContext.broadcast(
            index_items(block, words, radius, parts, every)
        )

        def clean(texts: list[str], index=index) -> np.ndarray:
            out = np.ones(len(texts), np.bool_)
            for i, _ in search(index.value, texts, words, threshold, radius, parts):
                out[i] = False
            return out

        docs = keep_rows(docs, clean)
    return docs


def _held(words: int):
    """The distinct shingles of each item, and a null for the item itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts_of(batch.column("text")):
                found, n = item_shingles(text, words)
                if n:
                    rows = [None, *np.unique(found).view(np.int64).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], ["shingle"])

    return run


def _counted(items: DataFrame, words: int) -> tuple[int, dict[int, int]]:
    """The number of items with words, and of those that hold each shingle of several."""
    counts = items.select("text").mapInArrow(_held(words), "shingle bigint").groupBy("shingle")
    rows = counts.count().where("shingle is null or count > 1").collect()
    total = sum(r["count"] for r in rows if r["shingle"] is None)
    several = {r["shingle"] % 2**64: r["count"] for r in rows if r["shingle"] is not None}
    return total, several


def _item_blocks(items: DataFrame, words: int) -> Iterator[tuple[list[tuple[int, str]], tuple | None]]:
    """The items, ``ITEM_BLOCK`` of them at a time, and the counts over all of them.

    Blocks bound the items on the driver and in a broadcast; beside them stand the shingles
    that several items hold. A shingle of one item has the usual weight and is not listed.
    """
    held = items.where("text is not null").select("item_id", "text")
    total = held.count()
    if total <= ITEM_BLOCK:
        rows = held.orderBy("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows], None
        return
    count = -(-total * 5 // (4 * ITEM_BLOCK))
    dealt = written(
        held.withColumn(
            "_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count))
        ),
        "items",
    )
    every = _counted(dealt, words)
    for block in range(count):
        rows = dealt.where(F.col("_block") == block).orderBy("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows], every
