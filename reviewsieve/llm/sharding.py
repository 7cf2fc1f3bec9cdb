"""A uniform shuffle into shards of exact sizes, from a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, on the driver: row
by row a multivariate hypergeometric draw from what the shards still have room for, which
is the law of a uniform permutation. Each partition then deals its own rows at random to
those counts, the rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsieve.llm.frames import written

# Rows of a shard that are permuted together. A shard has as many cells as it needs.
CELL_ROWS = 50_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the first shards take the remainder."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(parts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows from each partition to each shard, with exactly these margins."""
    rng = np.random.default_rng(seed)
    room = sizes.copy()
    out = np.empty((len(parts), len(sizes)), np.int64)
    for i, rows in enumerate(parts):
        # Large margins exceed numpy's own sampler; one shard after another is the same law.
        left, total = int(rows), int(room.sum())
        for j in range(len(sizes)):
            total -= int(room[j])
            take = _hypergeometric(rng, int(room[j]), total, left)
            out[i, j] = take
            left -= take
        room -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # Beyond the sampler's range: invert the distribution around its mean. What lies more than
    # twelve standard deviations off weighs less than rounding.
    total = good + bad
    mean = draws * (good / total)
    wide = 12 * math.sqrt(mean * (bad / total) * max(total - draws, 1) / (total - 1)) + 2
    low = max(0, draws - bad, math.floor(mean - wide))
    high = min(good, draws, math.ceil(mean + wide))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    sums = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def _deal(counts: dict[int, np.ndarray], seed: int):
    """Local permutation: row i of partition p gets the i-th of p's shuffled shard labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, of = None, None
        for batch in batches:
            part = batch.column("_part").to_numpy()
            at = batch.column("_at").to_numpy()
            shard = np.empty(len(part), np.int32)
            for p in np.unique(part):
                if p != of:
                    row = counts[int(p)]
                    labels, of = np.repeat(np.arange(len(row), dtype=np.int32), row), p
                    np.random.default_rng([seed, int(p)]).shuffle(labels)
                here = part == p
                shard[here] = labels[at[here]]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard)], [*names, "shard"]
            )

    return run


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Every row of ``df`` with ``shard`` and ``slot``: a uniform shuffle, sizes one apart.

    Slots count from 0 without gaps in each shard. Rows are told apart by place, so nulls,
    ties and repeated rows are dealt one by one; equal rows are not kept together. An empty
    table gives an empty result. ``df`` may have any columns but ``shard``, ``slot`` and
    names that begin with ``_``; those of these names are replaced.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("_")]
    place = F.monotonically_increasing_id()
    rows = written(
        df.select(*columns).select("*", place.alias("_place")), "rows"
    ).select(
        "*",
        F.shiftright("_place", 33).cast("int").alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    total = sum(p["n"] for p in parts)
    matrix = communication_matrix(
        np.array([p["n"] for p in parts], np.int64), shard_sizes(total, shards), seed
    )
    counts = {p["_part"]: row for p, row in zip(parts, matrix, strict=True)}
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())])
    cells = max(1, math.ceil(total / shards / CELL_ROWS))
    dealt = written(
        rows.mapInArrow(_deal(counts, seed), schema)
        .withColumn("_order", F.xxhash64(F.lit(seed), "_place"))
        .withColumn("_cell", F.pmod(F.shiftright("_order", 20), F.lit(cells)).cast("int")),
        "dealt",
    )
    earlier = Window.partitionBy("shard").orderBy("_cell")
    offsets = (
        dealt.groupBy("shard", "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(earlier) - F.col("_n"))
        .drop("_n")
    )
    inside = Window.partitionBy("shard", "_cell").orderBy("_order", "_place")
    return dealt.join(offsets, ["shard", "_cell"]).select(
        *columns,
        "shard",
        (F.col("_offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
    )
