"""Rows of many groups as blocks of a matrix, and sums over the blocks of a group.

Models of many runs or topics are worked on together: each group's rows are cut into blocks of a
bounded size, a block is one row with its features as a matrix, and what a group needs (gradients,
Gram matrices, cluster sums) is added up over its blocks, in two steps, so that neither the rows nor
the sums of a large group meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reviewsieve.session import BROADCAST_MAX_BYTES, broadcast_if_small, cut_lineage

BLOCK_ROWS = 2048
# Parts in which the sums of a group's blocks are added up before they meet.
PARTS = 32
# Bytes of blocks that reach a Python task at once; a larger block comes alone.
BATCH_BYTES = 16 * 1024 * 1024


def pack(
    rows: DataFrame, keys: list[str], carry: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """A written table of blocks: ``keys, blocks`` (of the group), ``block, x`` and arrays of ``carry``.

    ``x`` holds the block's features, row after row, as 64-bit floats. Blocks follow a hash of
    ``pmid``, rows in a block its order. ``keys`` are never null.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
    sizes = broadcast_if_small(cut_lineage(sizes))
    ids = dict.fromkeys(["pmid", *carry])
    dealt = rows.select(*keys, *[c for c in ids if c not in keys], "features").join(sizes, keys)
    block = F.pmod(F.xxhash64("pmid"), F.col("blocks")).alias("block")
    types = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType(
        [
            *[T.StructField(k, types[k]) for k in [*keys, "blocks"]],
            T.StructField("block", T.LongType()),
            T.StructField("x", T.BinaryType()),
            *[T.StructField(c, T.ArrayType(types[c])) for c in carry],
        ]
    )

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("pmid").combine_chunks()
        x = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out = [table.column(k).slice(0, 1).combine_chunks() for k in [*keys, "blocks", "block"]]
        out.append(pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()))
        for name in carry:
            values = table.column(name).combine_chunks()
            out.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.Table.from_arrays(out, [*keys, "blocks", "block", "x", *carry])

    packed = dealt.select("*", block).groupBy(*keys, "block").applyInArrow(one, schema)
    return cut_lineage(packed)


def matrix(x: bytes, n: int) -> np.ndarray:
    """A block's features as a matrix of ``n`` rows."""
    return np.frombuffer(x).reshape(n, -1)


def add_up(
    parts: DataFrame, keys: list[str], finish: Callable[[dict, np.ndarray], dict], schema: str
) -> DataFrame:
    """``finish(first row, sum)`` of each group's ``part``, a binary vector of 64-bit floats.

    ``parts`` has ``keys, block, part`` and columns that are the same in all rows of a group, which
    the first row shows. Blocks are added up in ``PARTS`` parts of the group first.
    """
    columns = parts.columns
    at = columns.index("part")

    def summed(table: pa.Table) -> np.ndarray:
        vectors = [np.frombuffer(b) for b in table.column("part").to_pylist()]
        return np.sum(vectors, axis=0)

    def partly(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        total = pa.array([summed(table).tobytes()], pa.binary())
        return table.slice(0, 1).set_column(at, "part", total)

    def wholly(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        row = finish(table.slice(0, 1).to_pylist()[0], summed(table))
        return pa.Table.from_pylist([row], target)

    structure, target = _schemas(parts, schema)
    few = parts.groupBy(*keys, F.pmod("block", F.lit(PARTS))).applyInArrow(partly, parts.schema)
    return few.groupBy(*keys).applyInArrow(wholly, structure)


def _schemas(df: DataFrame, schema: T.StructType | str) -> tuple[T.StructType, pa.Schema]:
    if isinstance(schema, str):
        schema = df.sparkSession.createDataFrame([], schema).schema
    return schema, to_arrow_schema(schema)


def map_rows(
    df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: T.StructType | str
) -> DataFrame:
    """Rows that ``make`` gives for each row of ``df``; a row is a block, so they are few."""
    structure, target = _schemas(df, schema)
    # A batch is cut by bytes too, or blocks of many groups would meet in memory.
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(make(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, target)

    return df.mapInArrow(run, structure)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], row_bytes: int) -> DataFrame:
    """``rows`` with their group's columns. The groups, ``row_bytes`` each, are counted first and
    broadcast below the limit; beyond it both sides are shuffled."""
    most = max(1, BROADCAST_MAX_BYTES // max(1, row_bytes))
    return rows.join(broadcast_if_small(groups, most), keys)
