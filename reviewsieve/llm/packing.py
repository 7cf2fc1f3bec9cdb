"""Packing documents into sequences: shortest pack first over the histogram of lengths.

Lengths are few, so the driver packs the histogram and never sees a document. A document of
more than ``size`` tokens gives full pieces, which are sequences of their own, and a rest.
Rests are placed longest first, always into the shortest pack that has room; packs of the
same make-up are one pattern with a count. Pieces then find their place by their rank among
the pieces of their length.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.llm.frames import bounded_batches, texts_of, written
from reviewsieve.llm.tokens import BatchTokenizer

SIZE = 2048
END_ID = 1
# Pieces of one length that are ranked together.
CELL_ROWS = 500


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of packs for a histogram of piece lengths from 1 to ``size``.

    Packs are held by their fill. A step places one piece each into as many packs of the smallest
    fill with room as there are, so the next step looks for the smallest fill anew; what finds
    no room opens new packs, each filled before the next one. The number of steps follows the
    patterns, not the counts.
    """
    open_: dict[int, list[list]] = {}
    fills: list[int] = []
    closed: list[tuple[int, tuple[int, ...]]] = []

    def hold(count: int, lengths: tuple[int, ...]) -> None:
        fill = sum(lengths)
        if not count:
            return
        if fill == size:
            closed.append((count, lengths))
            return
        if fill not in open_:
            heapq.heappush(fills, fill)
        open_.setdefault(fill, []).append([count, lengths])

    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        left = histogram[length]
        while left:
            while fills and fills[0] not in open_:
                heapq.heappop(fills)
            if not fills or fills[0] + length > size:
                fit = size // length
                whole, rest = divmod(left, fit)
                hold(whole, (length,) * fit)
                hold(1 if rest else 0, (length,) * rest)
                break
            count, lengths = open_[fills[0]].pop()
            if not open_[fills[0]]:
                del open_[fills[0]]
            used = min(count, left)
            hold(count - used, lengths)
            hold(used, lengths + (length,))
            left -= used
    return closed + [(c, tuple(p)) for packs in open_.values() for c, p in packs]


class Slots:
    """Where the pieces of each length go: by rank, runs of sequences at one offset."""

    def __init__(self, packs: list[tuple[int, tuple[int, ...]]]):
        packs = sorted(packs, key=lambda p: p[1], reverse=True)
        rows, sequence, seen = [], 0, {}
        for count, lengths in packs:
            offset = 0
            for length in lengths:
                rank = seen.get(length, 0)
                rows.append((length, rank, sequence, offset))
                seen[length] = rank + count
                offset += length
            sequence += count
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.sequences = sequence
        self.first = {}
        for i, length in enumerate(self.rows[:, 0].tolist()):
            self.first.setdefault(length, i)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        values, begin = np.unique(length[order], return_index=True)
        for value, here in zip(values.tolist(), np.split(order, begin[1:]), strict=True):
            a = self.first[value]
            b = int(np.searchsorted(self.rows[:, 0], value, "right"))
            own = self.rows[a:b]
            at = np.searchsorted(own[:, 1], rank[here], "right") - 1
            sequence[here] = own[at, 2] + rank[here] - own[at, 1]
            offset[here] = own[at, 3]
        return sequence, offset


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = BatchTokenizer(path)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc, ids in zip(docs, tokenizer.ids(texts_of(batch.column("text"))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece), len(ids)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def _place(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.place(
                batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            )
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)],
                [batch.schema.names[i] for i in keep] + ["sequence_id", "offset"],
            )

    return run


def pieces_of(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Documents in pieces of at most ``size`` ids: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _cut(path, size, end_id),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
    )


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``.

    Every piece is placed once; a sequence is filled from 0 without gaps. Other columns are
    kept, but for earlier ``sequence_id`` and ``offset`` and names that begin with ``_``.
    The patterns depend on the counts of the lengths alone, and at most ``size`` of those
    reach the driver. An empty table gives an empty result.
    """
    columns = [
        c for c in pieces.columns if c not in ("sequence_id", "offset") and not c.startswith("_")
    ]
    held = written(
        pieces.select(*columns, F.monotonically_increasing_id().alias("_place")), "pieces"
    )
    counts = {
        r["length"]: r["n"]
        for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    slots = Slots(patterns(counts, size))
    cells = max(1, math.ceil(max(counts.values(), default=0) / CELL_ROWS))
    cell = F.pmod(F.xxhash64("_place"), F.lit(cells)).cast("int")
    held = held.withColumn("_cell", cell)
    earlier = Window.partitionBy("length").orderBy("_cell")
    offsets = (
        held.groupBy("length", "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier) - F.col("_n"))
        .drop("_n")
    )
    inside = Window.partitionBy("length", "_cell").orderBy("_place")
    ranked = held.join(offsets, ["length", "_cell"]).select(
        *columns, (F.col("_before") + F.row_number().over(inside) - 1).alias("_rank")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return ranked.mapInArrow(_place(slots), f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """All documents in sequences of at most ``size`` ids, each document ended by ``end_id``.

    One row per piece. A null or empty text is its end id alone, repeated rows are packed
    one by one, a null doc_id stays null, and columns beside doc_id and text are ignored.
    """
    return pack(pieces_of(docs, path, size, end_id), size)
