"""Session defaults, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def build_session(app: str = "reviewsieve", **confs: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    ``maxFields`` is raised so that the per-dimension sums of vector means stay in
    one generated stage; skew handling and partition coalescing are left to AQE.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in confs.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names.

    That is ``spark.checkpoint.dir``, or what the context was given. Only a session in one
    process, without either, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="reviewsieve-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast a table of short rows, but only after counting it.

    Beyond the limit the table is returned as it is and Spark shuffles the join. Give a
    written table or a cheap selection of one, for it is read once more.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread a small table that may lie in one file over all cores by key.

    Only a table of less than ``BROADCAST_MAX_BYTES`` by Spark's own estimate is shuffled.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if int(str(size)) < BROADCAST_MAX_BYTES else df


def fresh(df: DataFrame) -> DataFrame:
    """The same table under new column identities, for a join with a table it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
