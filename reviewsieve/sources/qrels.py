"""Relevance judgements: four blank-separated columns, no header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 4


def read_qrels_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of all ``*.qrels`` files under the paths, with the file's name as source set."""
    lines = spark.read.option("pathGlobFilter", "*.qrels").text(paths)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.qrels$", "")
    return lines.select("value", name.alias("source_set"))


def _parsed(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.split(text, r"\s+")
    whole = lambda i, kind: F.get("_parts", F.lit(i)).try_cast(kind)
    rows = lines.where(text != "").withColumn("_parts", parts)
    bad = (
        F.when(F.size("_parts") != WIDTH, F.concat(F.lit("columns: "), F.size("_parts")))
        .when(whole(1, "int").isNull(), F.lit("misc is no whole number"))
        .when(whole(2, "bigint").isNull(), F.lit("pmid is no whole number"))
        .when(whole(3, "int").isNull(), F.lit("label is no whole number"))
    )
    return rows.select(
        "*",
        F.get("_parts", F.lit(0)).alias("cd"),
        whole(1, "int").alias("misc"),
        whole(2, "bigint").alias("pmid"),
        whole(3, "int").alias("label"),
        bad.alias("reason"),
    ).drop("_parts")


def judgements(lines: DataFrame) -> DataFrame:
    """Good lines as ``cd, misc, pmid, label`` beside the line's other columns."""
    return _parsed(lines).where(F.col("reason").isNull()).drop("value", "reason")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no judgement, each with the reason."""
    return _parsed(lines).where(F.col("reason").isNotNull()).drop("cd", "misc", "pmid", "label")


def topics(judged: DataFrame, topic: str = "cd") -> DataFrame:
    return judged.select(topic).distinct()


def of_topic(df: DataFrame, topic: str | Column, column: str = "cd") -> DataFrame:
    """Rows of one topic; on a table partitioned by topic only its folder is read."""
    return df.where(F.col(column) == topic)
