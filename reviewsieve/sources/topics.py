"""Topic tables: ``CD, Misc, PMID, label, title, abstract`` as CSV, one file per topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.functions.joins import last_version

TOPIC_SCHEMA = "CD string, Misc string, PMID string, label string, title string, abstract string"


def read_topic_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw rows with their place: file, block and row in the block. A missing path fails."""
    rows = (
        spark.read.schema(TOPIC_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(paths)
    )
    return rows.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )


def topic_articles(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Typed articles, one per ``(topic, pmid)``: values of the last row, place of the first.

    A label that is no whole number fails the job (ANSI cast). Blank text stays blank.
    """
    typed = rows.select(
        F.col("CD").alias("topic"),
        F.col("PMID").alias("pmid"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.col("label").cast("int").alias("label"),
        F.col(seq).alias("seq"),
    )
    return last_version(typed, ["topic", "pmid"], "seq").drop("seq")
