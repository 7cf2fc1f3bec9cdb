"""Nearest neighbours by inner product: stable projections in a kd-tree, checked as they come.

Inner products become distances: with M the largest norm, a row x gets one more component
sqrt(M^2 - |x|^2) and a query is stretched to norm M, so |q - x|^2 = 2 M^2 - 2 q.x. A few
Gaussian projections of a difference have squared length |q - x|^2 times a chi-square
variable. A kd-tree over the projections of a block of rows hands out leaves nearest first;
their rows are checked on the full vectors. A search ends when a row still unseen, were it
nearer than the k-th found, would have been seen already with the stated probability.

Queries meet rows in blocks of bounded size; each block pair keeps its best k per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.llm.frames import written

NEIGHBOURS = 20
PROJECTIONS = 8
CONFIDENCE = 0.95
LEAF = 256
ROW_BLOCK = 16_384
QUERY_BLOCK = 1_024
# What rounding may move a score by; only used to keep near ties until they are settled.
_SLACK = 1e-9


def chi_square_quantile(p: float, freedom: int) -> float:
    """Quantile for an even number of degrees of freedom (a finite sum), by bisection."""
    if freedom % 2:
        raise ValueError("take an even number of projections")

    def cdf(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class KdTree:
    """Rows in leaf order and the bounding boxes of the leaves; splits halve the widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.bounds = [0]
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                self.bounds.append(b)
                continue
            own = points[self.order[a:b]]
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            todo += [(a + middle, b), (a, a + middle)]
        spans = list(zip(self.bounds[:-1], self.bounds[1:], strict=True))
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in spans])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in spans])

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        out = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (out * out).sum(axis=1)


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose rounding depends on the two vectors alone."""
    return (rows * query).sum(axis=1)


def search(
    rows: np.ndarray,
    ids: np.ndarray,
    queries: np.ndarray,
    query_ids: np.ndarray,
    longest: float,
    k: int,
    projections: int = PROJECTIONS,
    confidence: float = CONFIDENCE,
    seed: int = 11,
) -> list[tuple[int, int, float]]:
    """``(query id, row id, score)`` of the best ``k`` rows of one block for each query."""
    width = rows.shape[1]
    matrix = np.random.default_rng([seed, width]).standard_normal((width + 1, projections))
    spare = np.sqrt(np.maximum(longest**2 - (rows * rows).sum(axis=1), 0))
    tree = KdTree(rows @ matrix[:-1] + spare[:, None] * matrix[-1])
    rows, ids = rows[tree.order], ids[tree.order]
    stretch = longest / np.sqrt((queries * queries).sum(axis=1))
    points = (queries * stretch[:, None]) @ matrix[:-1]
    limit = chi_square_quantile(confidence, projections)
    out: list[tuple[int, int, float]] = []
    for query, own, point, scale in zip(queries, query_ids, points, stretch, strict=True):
        gaps = tree.gaps(point)
        leaves = np.argsort(gaps, kind="stable")
        best = np.full(k, -np.inf)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        for leaf in leaves:
            distance = 2 * longest**2 - 2 * scale * best[0]
            if gaps[leaf] >= limit * max(distance, 0):
                break
            a, b = tree.bounds[leaf], tree.bounds[leaf + 1]
            scores = rows[a:b] @ query
            at = np.flatnonzero(scores >= best[0] - _SLACK * longest**2)
            at = at[ids[a:b][at] != own]
            if len(at):
                seen.append((at + a, scores[at]))
                best = np.sort(np.concatenate((best, scores[at])))[-k:]
        if not seen:
            continue
        at = np.concatenate([s[0] for s in seen])
        at = at[np.concatenate([s[1] for s in seen]) >= best[0] - _SLACK * longest**2]
        scores = exact(rows[at], query)
        order = np.lexsort((ids[at], -scores))[:k]
        out += [(int(own), int(ids[at[i]]), float(scores[i])) for i in order]
    return out


def _block(longest: dict[int, float], k: int, projections: int, confidence: float):
    def run(unit: pa.Table) -> pa.Table:
        width = unit.column("width")[0].as_py()
        asks = unit.column("asks").to_numpy().astype(bool)
        ids = unit.column("vec_id").to_numpy()
        flat = unit.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(-1, width)
        found = (
            search(vectors[~asks], ids[~asks], vectors[asks], ids[asks], longest[width], k,
                   projections, confidence)
            if asks.any() and not asks.all() else []
        )
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["query_id", "vec_id", "score"],
        )

    return run


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    projections: int = PROJECTIONS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` best rows that were found.

    ``vectors`` and ``queries`` hold ``vec_id, embedding``. Rows whose vec_id or embedding is
    null, zero, empty, or holds a null or non-finite component take no part; vectors meet
    vectors of their own width. A query's own vec_id is not among its rows. Equal scores go
    to the smaller vec_id, then repeated rows to one another. A query row that occurs more than
    once is asked once; of different vectors under one vec_id the shortest is asked, of these
    the first in the order of their components. Other columns are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        return (
            df.where("vec_id is not null and embedding is not null")
            .where(finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
            .select("vec_id", "vector", F.size("vector").alias("width"), F.sqrt(norm).alias("norm"))
            .where("norm > 0")
        )

    # One vector a query, however often it is asked.
    first = F.min(F.struct("width", "vector", "norm")).alias("q")
    once = clean(queries).groupBy("vec_id").agg(first).select("vec_id", "q.vector", "q.width", "q.norm")
    rows, asked = written(clean(vectors), "rows"), written(once, "queries")
    about = rows.groupBy("width").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).collect()
    longest = {r["width"]: r["norm"] for r in about}
    row_blocks = max([1, *(math.ceil(r["n"] / ROW_BLOCK) for r in about)])
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    columns = ["width", "row_block", "query_block", "asks", "vec_id", "vector"]
    units = (
        rows.withColumn("row_block", own(row_blocks))
        .withColumn("query_block", every(query_blocks))
        .withColumn("asks", F.lit(0))
        .select(*columns)
        .unionByName(
            asked.withColumn("query_block", own(query_blocks))
            .withColumn("row_block", every(row_blocks))
            .withColumn("asks", F.lit(1))
            .select(*columns)
        )
    )
    found = units.groupBy("width", "row_block", "query_block").applyInArrow(
        _block(longest, k, projections, confidence), "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
