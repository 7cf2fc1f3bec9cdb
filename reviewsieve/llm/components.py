"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm.frames import written


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour ``m`` of each u beside them.

    Least neighbours are aggregated and then joined back, so that a hub's edges never
    meet in one group. The few rows of the aggregate are dealt out once more: then both
    sides come to the join by an exchange of its own, and Spark can split a hub's share.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).repartition(parts)
    return edges.join(least, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root and no root points further."""
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
    state = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(roots, "u", "left")
    return not state.where("n > 1 or root = 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges (a, b)``; the label is the least node.

    Every round links each node's neighbours to its least one, first the larger and then
    the smaller neighbours; edge counts never grow beyond twice the input. It ends when
    all nodes point to a root, after about log(n) rounds.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u > v")
        .distinct(),
        "edges",
    )
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _star(both)
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        small = _star(large)
        moved = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = small.select("u", F.col("m").alias("v"))
        now = written(moved.unionByName(kept).distinct(), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
