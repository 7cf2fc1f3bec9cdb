"""Places of rows within their key's order, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsieve.llm.frames import written


def _count_runs(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the rows of each key in a sorted partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen, begun = None, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            new = np.ones(n, bool)
            new[0] = not begun or keys[0].as_py() != last
            if n > 1:
                new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            row = np.arange(n, dtype=np.int64)
            start = np.maximum.accumulate(np.where(new, row, -1))
            at = np.where(start < 0, row + seen, row - start)
            first = np.zeros(n, bool)
            first[0] = not begun
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at), pa.array(first)],
                [*batch.schema.names, "_part", "_at", "_first"],
            )
            last, seen, begun = keys[-1].as_py(), int(at[-1]) + 1, True

    return run


def placed(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place, from 0, among the rows of its ``key``.

    The table is cut into sorted ranges over all keys together, and each range numbers its own
    rows; only keys that go on across a border need what earlier ranges hold of them, which
    is two counts a range. So neither a key nor a tie has to fit a task, as long as ``order``
    ends in something that tells equal rows apart. ``key`` is never null. Give a written table:
    it is read twice, for its ranges and for its rows.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_at", T.LongType()),
            T.StructField("_first", T.BooleanType()),
        ]
    )
    ranges = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = written(ranges.mapInArrow(_count_runs(key), schema), "ordered")
    # At most one key a range goes on from the range before.
    crossing = rows.where("_first").select(key).distinct()
    counts = rows.join(F.broadcast(crossing), key).groupBy(key, "_part").agg(
        F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "_part", F.sum("_n").over(earlier).alias("_before"))
    joined = rows.join(F.broadcast(before), [key, "_part"], "left")
    return joined.select(*df.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias(name))
