"""Articles as points: the first two principal components, for every topic by itself.

A topic's covariance is a sum over its rows, so it is added up block by block: outer products of
blocks, taken around the topic's mean. All topics share the passes: one for the means, one for
the covariances, one for the points. A topic's covariance, the square of the features' width, is
what one task has to hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.vectors import mean_vectors, vector_size
from reviewsieve.operators.blocks import BLOCK_ROWS, add_up, map_rows, matrix, pack, with_groups
from reviewsieve.session import cut_lineage


def axes(covariance: np.ndarray) -> np.ndarray:
    """Two rows: the directions of the largest and the second largest variance.

    Each has its largest entry positive. One feature alone has no second direction: zeros.
    """
    _, vectors = np.linalg.eigh(covariance)
    found = vectors[:, ::-1].T[:2]
    largest = np.abs(found).argmax(axis=1)
    found = found * np.where(found[np.arange(len(found)), largest] < 0, -1, 1)[:, None]
    return np.vstack([found, np.zeros((2 - len(found), covariance.shape[0]))])


def project_topics(
    features: DataFrame, keys: list[str], by: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``keys, x, y`` of every row with its topic's two first principal components.

    ``by`` are the keys of a topic, all of them among ``keys``, and so is ``pmid``. Coordinates are
    taken from the origin, not from the mean. A topic of one row lies on the last features' axes.
    """
    carry = [k for k in keys if k not in by]
    blocks = pack(features, by, carry, block_rows)
    width = vector_size(features, "features")
    means = cut_lineage(mean_vectors(features, by, "features", width))
    types = {f.name: f.dataType.simpleString() for f in features.schema}
    topic = ", ".join(f"`{c}` {types[c]}" for c in by)
    of_topic = lambda row: {c: row[c] for c in by}

    def spread(row: dict) -> Iterator[dict]:
        gap = matrix(row["x"], len(row[carry[0]])) - np.array(row["mean"])
        yield of_topic(row) | {"block": row["block"], "part": (gap.T @ gap).tobytes()}

    def directions(row: dict, total: np.ndarray) -> dict:
        return of_topic(row) | {"axes": axes(total.reshape(width, width)).tobytes()}

    around = with_groups(blocks, means.select(*by, "mean"), by, 8 * width)
    parts = map_rows(around, spread, f"{topic}, block bigint, part binary")
    found = cut_lineage(add_up(parts, by, directions, f"{topic}, axes binary"))

    def points(row: dict) -> Iterator[dict]:
        n = len(row[carry[0]])
        at = matrix(row["x"], n) @ matrix(row["axes"], 2).T
        for i in range(n):
            kept = {c: row[c][i] for c in carry}
            yield of_topic(row) | kept | {"x": float(at[i, 0]), "y": float(at[i, 1])}

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, *carry]) + ", x double, y double"
    return map_rows(with_groups(blocks, found, by, 16 * width), points, schema).select(*keys, "x", "y")
