"""A Merkle manifest of a table: one tree per group of rows, one tree over the groups.

Rows become leaves in the order of their group. A tree is built as an append log: a node is
written as soon as its last leaf is there, after its own subtree, so nodes lie in postorder.
Builders work on aligned blocks of leaves; a block's own nodes are one stretch of the log, and
the blocks' roots are the leaves of the next layer of builders. Where a node lies follows from
subtree sizes alone: before leaf ``e`` as many nodes are complete as have all their leaves among
the first ``e``, that is ``sum(e >> k) = 2e - popcount(e)``, and the node of level ``k`` that ends
with leaf ``e`` comes ``k`` places later. So a proof reads its siblings out of the log by
position, block by block from the top down, and no node is ever joined to a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.llm.frames import written
from reviewsieve.llm.order import placed
from reviewsieve.session import broadcast_if_small

# A builder takes 2^BLOCK_BITS leaves: its log and its rows' proofs stay below a megabyte.
BLOCK_BITS = 10
DIGEST = 32
# One level of a proof: no sibling, a sibling on the left, or on the right; then its digest.
LONE, LEFT, RIGHT = 0, 1, 2
STEP = 1 + DIGEST


class Manifest(NamedTuple):
    """Trees as logs: ``leaves``, the builders' ``layers`` from the leaves up, ``roots``, the tree
    over the roots (None for that tree itself), and how many leaves a builder takes in bits."""

    leaves: DataFrame
    layers: list[DataFrame]
    roots: DataFrame
    top: Manifest | None
    bits: int


def record_digest(columns: list[Column]) -> Column:
    """Lower-case hex SHA-256 of values, each as ``-`` if null, else as bytes, ``:``, value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        said = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(said, F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def subtree_size(leaves: int, height: int) -> int:
    """Nodes of a tree of that height over so many leaves, a last node alone keeping its level."""
    return sum(-(-leaves >> k) for k in range(height + 1))


def height_of(leaves: int) -> int:
    return max(0, leaves - 1).bit_length()


def position(level, last_leaf):
    """Place in the log of the node of this level that ends with this leaf (numbers or arrays)."""
    return 2 * last_leaf - np.bitwise_count(last_leaf) + level


def _last_leaf(level: int, index, leaves: int):
    return np.minimum((index + 1) << level, leaves) - 1


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _block_height(nodes: int, bits: int) -> int:
    """Levels of a block in a layer of so many nodes: all of its bits unless it is the only one."""
    return bits if nodes > 1 << bits else height_of(nodes)


def append_log(digests: list[str], height: int) -> bytes:
    """All nodes over the given leaves in the order of their completion, 32 bytes each."""
    leaves = len(digests)
    log = np.empty((subtree_size(leaves, height), DIGEST), np.uint8)
    level = digests
    for k in range(height + 1):
        places = position(k, _last_leaf(k, np.arange(len(level)), leaves))
        log[places] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        if k < height:
            level = [_hash(*level[p : p + 2]) for p in range(0, len(level), 2)]
    return log.tobytes()


def _segment(bits: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        nodes = table.column("_n")[0].as_py()
        digests = [d.hex() for d in table.column("_digest").to_pylist()]
        row = {
            "_tree": [table.column("_tree")[0].as_py()],
            "_block": [table.column("_i")[0].as_py() >> bits],
            "_n": [nodes],
            "_log": [append_log(digests, _block_height(nodes, bits))],
        }
        return pa.table(row, pa.schema([("_tree", pa.string()), ("_block", pa.int64()),
                                        ("_n", pa.int64()), ("_log", pa.binary())]))

    return build


def _last_digest(log: str) -> Column:
    return F.substring(F.col(log), -DIGEST, DIGEST)


def _grow(leaves: DataFrame, top: bool, bits: int) -> Manifest:
    """Logs of all trees, layer by layer; ``leaves`` has ``_tree, _i, _n, _digest`` and more."""
    layers: list[DataFrame] = []
    roots = None
    nodes = leaves.select("_tree", "_i", "_n", "_digest")
    size = 1 << bits
    while True:
        grouped = nodes.groupBy("_tree", F.shiftright("_i", bits).alias("_block"))
        built = grouped.applyInArrow(
            _segment(bits), "_tree string, _block long, _n long, _log binary"
        )
        layer = written(built, f"log{len(layers)}")
        layers.append(layer)
        done = layer.where(F.col("_n") <= size).select("_tree", _last_digest("_log").alias("_digest"))
        roots = done if roots is None else roots.unionByName(done)
        rest = layer.where(F.col("_n") > size)
        if not rest.limit(1).count():
            break
        nodes = rest.select(
            "_tree",
            F.col("_block").alias("_i"),
            F.ceil(F.col("_n") / size).alias("_n"),
            _last_digest("_log").alias("_digest"),
        )
    if top:
        return Manifest(leaves, layers, roots, None, bits)
    names = written(roots.select(F.lit("").alias("_all"), "_tree", "_digest"), "roots")
    ranked = placed(names, "_all", [F.col("_tree")], "_i")
    over = ranked.select(
        F.col("_tree").alias("_name"), F.col("_all").alias("_tree"), "_i",
        F.lit(names.count()).cast("long").alias("_n"), "_digest",
    )
    return Manifest(leaves, layers, roots, _grow(over, True, bits), bits)


def build(
    rows: DataFrame,
    leaf: Column,
    group: str,
    order: str,
    keep: dict[str, Column],
    bits: int = BLOCK_BITS,
) -> Manifest:
    """The manifest of ``rows``: their leaves by ``order`` in one tree per value of ``group``.

    ``leaf`` is a row's hex digest. In a tree every two consecutive nodes become the digest of
    their hex texts, a last one alone too, until one is left: the subroot. Subroots in the order of
    their groups, null first and else by UTF-8 bytes, become the root alike. ``keep`` names
    columns that go along to the proofs.

    Nulls in ``order`` come first; ties follow the leaf's digest, so equal rows are interchangeable
    and each has a leaf of its own. A table without rows has neither leaves nor a root. Only
    ``group``, ``order`` and what the expressions read are taken from ``rows``, so other columns do
    not matter; names in ``keep`` must not begin with ``_``.
    """
    name = F.col(group).cast("string")
    tree = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), name))
    made = rows.select(
        tree.alias("_tree"),
        F.col(order).alias("_order"),
        F.unhex(leaf).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
        *[column.alias(c) for c, column in keep.items()],
    )
    made = written(made, "leaves")
    ranked = placed(made, "_tree", [F.col("_order"), F.col("_digest"), F.col("_row")], "_i")
    sizes = written(made.groupBy("_tree").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    leaves = ranked.join(broadcast_if_small(sizes), "_tree").select("_tree", "_i", "_n", "_digest", *keep)
    return _grow(written(leaves, "placed"), False, bits)


def log_of(manifest: Manifest) -> DataFrame:
    """The whole append log: ``tree, position, digest`` (hex), gapless from 0 in each tree.

    ``tree`` is ``+`` and the group's name, or empty for the group of null.
    """

    def nodes(layer: int, bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = layer * bits
            for batch in batches:
                for row in batch.to_pylist():
                    held = min(1 << bits, row["_n"] - (row["_block"] << bits))
                    height = _block_height(row["_n"], bits)
                    count = row["_leaves"]
                    digests = np.frombuffer(row["_log"], np.uint8).reshape(-1, DIGEST)
                    places, at = [], []
                    # The layer above holds the roots of this one as its own leaves.
                    for k in range(0 if layer == 0 else 1, height + 1):
                        index = np.arange(-(-held >> k))
                        at.append(position(k, _last_leaf(k, index, held)))
                        first = (row["_block"] << bits >> k) + index
                        places.append(position(below + k, _last_leaf(below + k, first, count)))
                    if not at:
                        continue
                    taken = digests[np.concatenate(at)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["_tree"]] * len(taken), pa.string()),
                            pa.array(np.concatenate(places), pa.int64()),
                            pa.array([d.tobytes().hex() for d in taken], pa.string()),
                        ],
                        ["tree", "position", "digest"],
                    )

        return run

    counts = manifest.layers[0].select("_tree", F.col("_n").alias("_leaves")).distinct()
    out = None
    for layer, segments in enumerate(manifest.layers):
        rows = segments.join(counts, "_tree").mapInArrow(
            nodes(layer, manifest.bits), "tree string, position long, digest string"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _siblings(bits: int):
    """Proof steps of a block's leaves, read from its log by position; the block's own follow."""

    def run(children: pa.Table, segment: pa.Table) -> pa.Table:
        if not children.num_rows or not segment.num_rows:
            return children.select([c for c in children.column_names if c != "_n"]).slice(0, 0)
        nodes, block = segment.column("_n")[0].as_py(), segment.column("_block")[0].as_py()
        above = segment.column("_above")[0].as_py()
        log = np.frombuffer(segment.column("_log")[0].as_py(), np.uint8).reshape(-1, DIGEST)
        held = min(1 << bits, nodes - (block << bits))
        height = _block_height(nodes, bits)
        leaf = children.column("_i").to_numpy() - (block << bits)
        steps = np.zeros((len(leaf), height, STEP), np.uint8)
        for k in range(height):
            other = (leaf >> k) ^ 1
            there = np.flatnonzero(other << k < held)
            other = other[there]
            steps[there, k, 0] = np.where(other & 1, RIGHT, LEFT)
            steps[there, k, 1:] = log[position(k, _last_leaf(k, other, held))]
        proofs = [row.tobytes() + above for row in steps]
        place = children.column_names.index("_proof")
        return children.set_column(place, "_proof", pa.array(proofs, pa.binary()))

    return run


def _descend(manifest: Manifest, tops: DataFrame) -> DataFrame:
    """Leaves with ``_proof``. ``tops``: ``_tree, _above``, the steps from each tree's root on."""
    size = 1 << manifest.bits
    down = None
    for layer in range(len(manifest.layers) - 1, -1, -1):
        segments = manifest.layers[layer]
        above = segments.where(F.col("_n") <= size).join(tops, "_tree")
        if down is not None:
            more = segments.where(F.col("_n") > size).join(
                down.withColumnRenamed("_i", "_block"), ["_tree", "_block"]
            )
            above = above.unionByName(more.select(*above.columns))
        if layer:
            below = manifest.layers[layer - 1].where(F.col("_n") > size)
            children = below.select("_tree", F.col("_block").alias("_i"))
        else:
            children = manifest.leaves
        children = children.drop("_n").withColumn("_proof", F.lit(b""))
        block = F.shiftright("_i", manifest.bits).alias("_block")
        above = above.select(*[F.col(c).alias(c) for c in above.columns])
        proved = (
            children.groupBy("_tree", block)
            .cogroup(above.groupBy("_tree", "_block"))
            .applyInArrow(_siblings(manifest.bits), children.schema)
        )
        if not layer:
            return proved
        down = written(proved, f"paths{layer}").select("_tree", "_i", F.col("_proof").alias("_above"))
    raise AssertionError("a manifest has a layer")


def proofs(manifest: Manifest) -> DataFrame:
    """Each leaf with its proof: kept columns, ``leaf_index, leaf, subroot, root, proof``.

    ``proof`` has one step of 33 bytes a level, from the leaf to the root: 0 (no sibling), 1 (a
    sibling on the left) or 2 (on the right), and the sibling's digest. Digests elsewhere are hex.
    """
    hexed = lambda c: F.lower(F.hex(c))
    over = manifest.top
    start = over.roots.select("_tree", F.lit(b"").alias("_above"))
    tops = _descend(over, start).select(
        F.col("_name").alias("_tree"), F.col("_proof").alias("_above"), F.col("_digest").alias("_subroot")
    )
    tops = written(tops, "tops")
    root = over.roots.select(hexed("_digest").alias("root")).first()
    proved = _descend(manifest, tops.select("_tree", "_above"))
    ends = broadcast_if_small(tops.select("_tree", hexed("_subroot").alias("subroot")))
    kept = [c for c in manifest.leaves.columns if not c.startswith("_")]
    return proved.join(ends, "_tree").select(
        *kept, F.col("_i").alias("leaf_index"), hexed("_digest").alias("leaf"), "subroot",
        F.lit(root and root["root"]).alias("root"), F.col("_proof").alias("proof"),
    )


def siblings(proof: bytes) -> list[str]:
    """The siblings of a proof in hex, level by level."""
    steps = (proof[k : k + STEP] for k in range(0, len(proof), STEP))
    return [s[1:].hex() for s in steps if s[0] != LONE]


def fold(leaf: str, proof: bytes) -> str:
    """The root that a leaf's digest and a proof lead to."""
    node = leaf
    for k in range(0, len(proof), STEP):
        side = proof[k]
        if side == LONE:
            node = _hash(node)
        else:
            other = proof[k + 1 : k + STEP].hex()
            node = _hash(other, node) if side == LEFT else _hash(node, other)
    return node


def folded(proved: DataFrame, leaf: str) -> DataFrame:
    """Proofs checked row by row: adds ``folded_root`` and ``proof_sha256``, the digest of all
    siblings' hex texts. ``leaf`` names the column of the digest that is to be proved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(leaf).to_pylist()
            paths = batch.column("proof").to_pylist()
            roots = [fold(a, b) for a, b in zip(given, paths, strict=True)]
            marks = [_hash(*siblings(p)) for p in paths]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(roots, pa.string()), pa.array(marks, pa.string())],
                [*batch.schema.names, "folded_root", "proof_sha256"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proved.schema)
    return proved.mapInArrow(run, f"{schema}, folded_root string, proof_sha256 string")
