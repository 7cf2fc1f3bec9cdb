"""Logistic regression of many runs at once, by Newton steps on blocks of labelled rows.

Minimised per run: the sum of log losses + |w|^2 / (2C), without a penalty on the intercept. A run
that fits one block is driven to its optimum where the block is, all such runs in one pass. For
larger runs a step is one pass over all their blocks: each block gives its loss, gradient and
Hessian at its run's coefficients, the sums over blocks give the next coefficients, and the table of
coefficients goes back to the blocks. So the number of jobs follows the steps, not the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.operators.blocks import BLOCK_ROWS, add_up, map_rows, matrix, pack, with_groups
from reviewsieve.session import broadcast_if_small, cut_lineage

# Inverse strength of the penalty, how far a fit is driven, and its longest way.
PENALTY_C = 1.0
TOLERANCE = 1e-8
MAX_STEPS = 100
# A step that raises the loss by more than rounding is taken back by half.
SLACK = 1e-12


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the rows at ``w`` (the intercept last), in one vector."""
    z = x @ w[:-1] + w[-1]
    p = 0.5 * (1 + np.tanh(z / 2))
    loss = np.sum(np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))))
    s = p * (1 - p)
    d = x.shape[1]
    hessian = np.empty((d + 1, d + 1))
    hessian[:d, :d] = (x * s[:, None]).T @ x
    hessian[:d, d] = hessian[d, :d] = s @ x
    hessian[d, d] = s.sum()
    return np.concatenate(([loss], (p - y) @ x, [np.sum(p - y)], hessian.ravel()))


class State:
    """Where a fit stands: the last accepted coefficients, their loss, and the ones to try."""

    def __init__(self, trial, accepted=None, loss=np.inf, steps=0, gradient=np.inf):
        self.trial = np.asarray(trial, float)
        self.accepted = self.trial if accepted is None else np.asarray(accepted, float)
        self.loss, self.steps, self.gradient = loss, steps, gradient

    @property
    def done(self) -> bool:
        near = self.steps > 0 and self.gradient <= TOLERANCE * max(1, self.loss)
        return near or self.steps >= MAX_STEPS

    def step(self, total: np.ndarray, c: float) -> State:
        """The next state, from the sums over all rows at the coefficients to try."""
        w, d = self.trial, len(self.trial) - 1
        loss = total[0] + w[:-1] @ w[:-1] / (2 * c)
        if loss > self.loss + SLACK * abs(self.loss):
            half = (self.accepted + w) / 2
            return State(half, self.accepted, self.loss, self.steps + 1, self.gradient)
        gradient = total[1 : d + 2].copy()
        gradient[:d] += w[:-1] / c
        hessian = total[d + 2 :].reshape(d + 1, d + 1).copy()
        hessian[np.arange(d), np.arange(d)] += 1 / c
        # Far out, where all probabilities are 0 or 1, the intercept has no curvature left.
        hessian[d, d] += 1e-12
        move = np.linalg.solve(hessian, gradient)
        return State(w - move, w, loss, self.steps + 1, float(np.abs(gradient).max()))


def fit_rows(x: np.ndarray, y: np.ndarray, c: float = PENALTY_C) -> State:
    """The optimum for rows at hand. With fewer rows than features the weights are a combination
    of the rows, so the fit runs in their coordinates."""
    basis = None
    if len(x) < x.shape[1]:
        basis, coordinates = np.linalg.qr(x.T)
        x = coordinates.T
    state = State(np.zeros(x.shape[1] + 1))
    while not state.done:
        state = state.step(sums(x, y, state.trial), c)
    if basis is not None:
        lift = lambda w: np.append(basis @ w[:-1], w[-1])
        state = State(lift(state.trial), lift(state.accepted), state.loss, state.steps, state.gradient)
    return state


def fit_runs(
    labelled: DataFrame, keys: list[str], c: float = PENALTY_C, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``keys, coefficients`` (the intercept last), ``gradient, steps`` per run, a written table.

    ``labelled``: ``keys, pmid, features, label``. Runs whose labels are not exactly 0 and 1 are
    left out. ``gradient`` is the largest entry of the penalised loss's gradient at the
    coefficients; it is above ``TOLERANCE`` (times the loss, if that is above 1) only where
    ``MAX_STEPS`` ended the fit.
    """
    label = F.col("label").cast("double")
    counted = labelled.groupBy(*keys).agg(
        F.count_if(label == 1).alias("_1"), F.count_if(label == 0).alias("_0"),
        F.count(F.lit(1)).alias("_n"),
    )
    both = counted.where((F.col("_1") > 0) & (F.col("_0") > 0) & (F.col("_1") + F.col("_0") == F.col("_n")))
    able = broadcast_if_small(cut_lineage(both.select(*keys)))
    rows = labelled.withColumn("label", label).join(able, keys, "left_semi")
    blocks = pack(rows, keys, ["label"], block_rows)
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    key_types = ", ".join(f"{k} {types[k]}" for k in keys)
    found = f"{key_types}, coefficients array<double>, gradient double, steps int"

    def whole(row: dict) -> Iterator[dict]:
        state = fit_rows(matrix(row["x"], len(row["label"])), np.array(row["label"]), c)
        yield {k: row[k] for k in keys} | {
            "coefficients": state.accepted.tolist(), "gradient": state.gradient, "steps": state.steps
        }

    small = cut_lineage(map_rows(blocks.where("blocks = 1"), whole, found))
    large = blocks.where("blocks > 1")
    if not large.limit(1).count():
        return small
    return small.unionByName(_fit_large(large, keys, key_types, c).select(*small.columns))


def _fit_large(blocks: DataFrame, keys: list[str], key_types: str, c: float) -> DataFrame:
    width = len(blocks.select("x").first()["x"]) // 8 // len(blocks.select("label").first()["label"])
    schema = f"{key_types}, trial array<double>, accepted array<double>, loss double, steps int, gradient double"
    part = f"{schema}, block bigint, part binary"
    zeros = F.array_repeat(F.lit(0.0), width + 1)
    infinite = F.lit(float("inf"))
    states = blocks.select(*keys).distinct().select(
        *keys, zeros.alias("trial"), zeros.alias("accepted"), infinite.alias("loss"),
        F.lit(0).alias("steps"), infinite.alias("gradient"),
    )
    fields = ("trial", "accepted", "loss", "steps", "gradient")

    def measure(row: dict) -> Iterator[dict]:
        at = sums(matrix(row["x"], len(row["label"])), np.array(row["label"]), np.array(row["trial"]))
        kept = {k: row[k] for k in (*keys, *fields, "block")}
        yield kept | {"part": at.tobytes()}

    def move(row: dict, total: np.ndarray) -> dict:
        state = State(*[row[f] for f in fields]).step(total, c)
        return {k: row[k] for k in keys} | {
            "trial": state.trial.tolist(), "accepted": state.accepted.tolist(),
            "loss": float(state.loss), "steps": state.steps, "gradient": state.gradient,
        }

    ended = None
    states = cut_lineage(states)
    while True:
        parts = map_rows(with_groups(blocks, states, keys, 16 * (width + 1)), measure, part)
        states = cut_lineage(add_up(parts, keys, move, schema))
        near = F.col("gradient") <= TOLERANCE * F.greatest(F.lit(1.0), "loss")
        over = near | (F.col("steps") >= MAX_STEPS)
        done = states.where(over)
        ended = done if ended is None else ended.unionByName(done)
        states = states.where(~over)
        if not states.limit(1).count():
            return ended.withColumnRenamed("accepted", "coefficients")


def probability(features: Column, coefficients: Column) -> Column:
    """Probability of label 1 for a row of features."""
    products = F.zip_with(features, coefficients, lambda x, w: x.cast("double") * w)
    # The intercept has no feature beside it.
    z = F.aggregate(products, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    z = z + F.element_at(coefficients, -1)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_runs(candidates: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of the fitted runs with ``p``, the probability of label 1."""
    first = fitted.select(F.size("coefficients").alias("n")).first()
    width = first["n"] if first else 1
    rows = with_groups(candidates, fitted.select(*keys, "coefficients"), keys, 8 * width)
    p = probability(F.col("features"), F.col("coefficients")).alias("p")
    return rows.select(*candidates.columns, p)
