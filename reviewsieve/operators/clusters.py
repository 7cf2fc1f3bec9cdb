"""k-means of many runs at once, repeatable: seeds by keyed draws, then Lloyd's steps on blocks.

Seeding follows k-means||: from one drawn row on, a few rounds each take every row with a chance that
grows with its squared distance to what has been taken; the rows taken are weighed by how many rows
are nearest to them and reduced to k, the heaviest first, then always the one with the largest
weight times squared distance to those chosen. All chances are keyed draws, so the result does
not depend on partitions. A run that fits one block is clustered where the block is; for larger
runs every round and every step is one pass over all blocks of all such runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.hashing import unit_draw
from reviewsieve.operators.blocks import BLOCK_ROWS, add_up, map_rows, matrix, pack, with_groups
from reviewsieve.operators.pool import ROUND, RUN
from reviewsieve.session import cut_lineage

# Rounds of seeding, rows wanted in each as a multiple of k, and Lloyd's steps.
SEED_ROUNDS = 3
OVERSAMPLING = 2
STEPS = 10


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, one column a centre."""
    out = np.empty((len(x), len(centres)))
    for i, centre in enumerate(centres):
        gap = x - centre
        out[:, i] = np.einsum("ij,ij->i", gap, gap)
    return out


def reduce_seeds(seeds: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the weighted seeds, which come in the order that breaks ties."""
    if len(seeds) <= k:
        return seeds
    chosen = [int(np.argmax(weights))]
    gap = squared(seeds, seeds[chosen])[:, 0]
    while len(chosen) < k:
        chosen.append(int(np.argmax(weights * gap)))
        gap = np.minimum(gap, squared(seeds, seeds[chosen[-1:]])[:, 0])
    return seeds[chosen]


def cluster_sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per centre the number of its nearest rows and their sum, as one vector."""
    nearest = squared(x, centres).argmin(axis=1)
    out = np.zeros((len(centres), 1 + x.shape[1]))
    np.add.at(out, nearest, np.c_[np.ones(len(x)), x])
    return out.ravel()


def moved(total: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The means of the clusters; a centre without rows stays."""
    total = total.reshape(len(centres), -1)
    count = total[:, :1]
    return np.where(count > 0, total[:, 1:] / np.maximum(count, 1), centres)


def cluster_rows(x: np.ndarray, chance: np.ndarray, k: int) -> np.ndarray:
    """Clusters of rows at hand, which come in the order that breaks ties."""
    taken = np.zeros(len(x), bool)
    taken[0] = True
    for u in chance.T:
        gap = squared(x, x[taken]).min(axis=1)
        total = gap.sum()
        if total == 0:
            break
        taken |= u * total < OVERSAMPLING * k * gap
    seeds = x[taken]
    weights = np.bincount(squared(x, seeds).argmin(axis=1), minlength=len(seeds))
    centres = reduce_seeds(seeds, weights, k)
    for _ in range(STEPS):
        new = moved(cluster_sums(x, centres), centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return squared(x, centres).argmin(axis=1)


def cluster_runs(
    candidates: DataFrame, k: int, seed: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``topic, policy, run, round, pmid, draw, cluster``: at most ``k`` clusters a run, from 0.

    ``candidates``: ``topic, policy, run, round, pmid, draw, features``. Ties go by draw, then id.
    Rows that are all alike are one cluster; a run may get fewer than ``k``.
    """
    chances = F.array(*[unit_draw(seed, i, "draw") for i in range(SEED_ROUNDS)])
    rows = candidates.withColumn("_chance", chances)
    blocks = pack(rows, RUN, ["round", "pmid", "draw", "_chance"], block_rows)
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    found = ", ".join(f"{c} {types[c]}" for c in [*ROUND, "pmid", "draw"]) + ", cluster int"

    def rows_of(row: dict, cluster: np.ndarray) -> Iterator[dict]:
        run = {c: row[c] for c in RUN}
        for i, number in enumerate(cluster):
            kept = {c: row[c][i] for c in ("round", "pmid", "draw")}
            yield run | kept | {"cluster": int(number)}

    def whole(row: dict) -> Iterator[dict]:
        n = len(row["pmid"])
        order = sorted(range(n), key=lambda i: (row["draw"][i], row["pmid"][i]))
        x, chance = matrix(row["x"], n)[order], np.array(row["_chance"])[order]
        cluster = np.empty(n, int)
        cluster[order] = cluster_rows(x, chance, k)
        yield from rows_of(row, cluster)

    small = map_rows(blocks.where("blocks = 1"), whole, found)
    large = blocks.where("blocks > 1")
    if not large.limit(1).count():
        return small
    centres = _large_centres(large, k, types)

    def assigned(row: dict) -> Iterator[dict]:
        x = matrix(row["x"], len(row["pmid"]))
        yield from rows_of(row, squared(x, matrix(row["centres"], row["n"])).argmin(axis=1))

    width = _width(large)
    placed = with_groups(large, centres, RUN, 8 * width * k)
    return small.unionByName(map_rows(placed, assigned, found))


def _width(blocks: DataFrame) -> int:
    row = blocks.select(F.length("x").alias("bytes"), F.size("pmid").alias("n")).first()
    return row["bytes"] // 8 // row["n"]


def _large_centres(blocks: DataFrame, k: int, types: dict[str, str]) -> DataFrame:
    """``topic, policy, run, n, centres`` of runs of more than one block."""
    width = _width(blocks)
    run = ", ".join(f"{c} {types[c]}" for c in RUN)
    seed = f"draw string, pmid {types['pmid']}, x binary"
    of_run = lambda row: {c: row[c] for c in RUN}

    def first(row: dict) -> Iterator[dict]:
        i = min(range(len(row["pmid"])), key=lambda i: (row["draw"][i], row["pmid"][i]))
        x = matrix(row["x"], len(row["pmid"]))
        yield of_run(row) | {"draw": row["draw"][i], "pmid": row["pmid"][i], "x": x[i].tobytes()}

    firsts = map_rows(blocks, first, f"{run}, {seed}")
    seeds = firsts.groupBy(*RUN).agg(F.min(F.struct("draw", "pmid", "x")).alias("s"))
    seeds = cut_lineage(seeds.select(*RUN, "s.*"))

    def listed(seeds: DataFrame) -> DataFrame:
        """One row a run: its seeds in order as a matrix. There are about 2k a round."""
        ordered = F.array_sort(F.collect_list(F.struct("draw", "pmid", "x")))
        return seeds.groupBy(*RUN).agg(F.count(F.lit(1)).cast("int").alias("n"), ordered.alias("s")).select(
            *RUN, "n", F.aggregate("s", F.lit(b""), lambda a, b: F.concat(a, b["x"])).alias("centres")
        )

    for i in range(SEED_ROUNDS):
        def taken(row: dict, i: int = i) -> Iterator[dict]:
            n = len(row["pmid"])
            x = matrix(row["x"], n)
            gap = squared(x, matrix(row["centres"], row["n"])).min(axis=1)
            # A row is taken if chance * total < 2k * gap. The block's own total is at most the
            # run's, so what fails here fails there.
            chance = np.array(row["_chance"])[:, i]
            may = np.flatnonzero(chance * gap.sum() < OVERSAMPLING * k * gap)
            rows = [
                {"draw": row["draw"][j], "pmid": row["pmid"][j], "x": x[j].tobytes(),
                 "chance": float(chance[j]), "gap": float(gap[j])}
                for j in may
            ]
            yield of_run(row) | {"total": float(gap.sum()), "rows": rows}

        fields = f"draw:string,pmid:{types['pmid']},x:binary,chance:double,gap:double"
        with_seeds = with_groups(blocks, cut_lineage(listed(seeds)), RUN, 8 * width * (1 + 2 * k * i))
        offered = cut_lineage(
            map_rows(with_seeds, taken, f"{run}, total double, rows array<struct<{fields}>>")
        )
        totals = offered.groupBy(*RUN).agg(F.sum("total").alias("all"))
        rows = offered.select(*RUN, F.inline("rows")).join(F.broadcast(totals), RUN)
        more = rows.where(F.col("chance") * F.col("all") < OVERSAMPLING * k * F.col("gap"))
        seeds = cut_lineage(seeds.unionByName(more.select(*seeds.columns)))

    def weigh(row: dict) -> Iterator[dict]:
        x = matrix(row["x"], len(row["pmid"]))
        nearest = squared(x, matrix(row["centres"], row["n"])).argmin(axis=1)
        weights = np.bincount(nearest, minlength=row["n"]).astype(float)
        yield of_run(row) | {
            "block": row["block"], "n": row["n"], "centres": row["centres"], "part": weights.tobytes()
        }

    def chosen(row: dict, weights: np.ndarray) -> dict:
        centres = reduce_seeds(matrix(row["centres"], row["n"]), weights, k)
        return of_run(row) | {"n": len(centres), "centres": centres.tobytes(), "steps": 0, "still": False}

    part = f"{run}, block bigint, n int, centres binary, part binary"
    state = f"{run}, n int, centres binary, steps int, still boolean"
    all_seeds = with_groups(blocks, cut_lineage(listed(seeds)), RUN, 8 * width * (1 + 2 * k * SEED_ROUNDS))
    centres = cut_lineage(add_up(map_rows(all_seeds, weigh, part), RUN, chosen, state))

    def measure(row: dict) -> Iterator[dict]:
        x = matrix(row["x"], len(row["pmid"]))
        total = cluster_sums(x, matrix(row["centres"], row["n"]))
        kept = {c: row[c] for c in (*RUN, "block", "n", "centres", "steps")}
        yield kept | {"part": total.tobytes()}

    def step(row: dict, total: np.ndarray) -> dict:
        before = matrix(row["centres"], row["n"])
        after = moved(total, before)
        return of_run(row) | {
            "n": row["n"], "centres": after.tobytes(), "steps": row["steps"] + 1,
            "still": bool(np.array_equal(before, after)),
        }

    part = f"{run}, block bigint, n int, centres binary, steps int, part binary"
    ended = None
    while True:
        parts = map_rows(with_groups(blocks, centres, RUN, 8 * width * k), measure, part)
        centres = cut_lineage(add_up(parts, RUN, step, state))
        over = F.col("still") | (F.col("steps") >= STEPS)
        done = centres.where(over)
        ended = done if ended is None else ended.unionByName(done)
        centres = centres.where(~over)
        if not centres.limit(1).count():
            return ended.select(*RUN, "n", "centres")
