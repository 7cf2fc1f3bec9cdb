"""Word vectors: ``word string, vector array<float>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_word_vectors(lines: DataFrame) -> DataFrame:
    """Vectors from text lines ``word v1 v2 ...``; a ``count width`` heading is skipped."""
    parts = F.split(F.rtrim("value"), " ")
    return lines.select(parts.alias("_parts")).where(F.size("_parts") > 2).select(
        F.get("_parts", F.lit(0)).alias("word"),
        F.slice("_parts", F.lit(2), F.size("_parts") - 1).cast("array<float>").alias("vector"),
    )


def read_word_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "text":
        return parse_word_vectors(spark.read.text(path))
    return spark.read.format(fmt).load(path).select("word", "vector")
