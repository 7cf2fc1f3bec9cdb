"""Reading, shared folders and bounded batches for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.session import checkpoint_folder

# Bytes of texts that reach a Python task at once; one longer row comes alone.
BATCH_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Cut batches for Python by bytes too, so that many long texts do not meet in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared folder that the cluster names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again.

    ``row_group`` bounds the bytes that a task gathers before it writes them; tables with whole
    texts want less than the usual 128 MB, for all tasks of an executor gather at once.
    """
    path = shared_folder(df.sparkSession, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, wanted: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Rows of ``docs`` whose text is ``wanted``, decided batch by batch where the rows are.

    Only the text goes to Python and only the decision comes back. All columns stay as they are
    and nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def keep(texts: pa.Array) -> pa.Array:
        return pa.array(wanted(texts_of(texts)), pa.bool_())

    return docs.where(keep("text"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A text column as strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))
