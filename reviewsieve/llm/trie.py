"""The prefix trie of a table of conversations, all of its nodes aggregated by ROLLUP.

A turn is an id of 24 bytes: a digest of role and text, and the text's words. A conversation lies
in blocks of ``WIDTH`` turns, one row a block with a column a turn, and every block is keyed by
the node that the block before ends in; so one ROLLUP over the columns gives the nodes of all
depths and all blocks together. A node's key is a sum of digests of its turns with their
positions, which buckets can add up, so that a long conversation is never one task.

The node's numbers are sums over its members. The smallest member owns a node. A member owns the
rest of its path from some depth on: of what lies above, it shares every word. So the saved
words of a subtree are the shared words of its members, and its leaves are the members that
own one. A first ROLLUP finds the owners, a second one adds up.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import sums_before
from reviewsieve.llm.frames import written
from reviewsieve.llm.order import placed

# Turns to a block; a ROLLUP makes one row more than that of every block.
WIDTH = 8
# Ids of members that are listed together before their node's digest is taken.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes: half of a SHA-256 of role and text, then the text's number of words."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return F.unhex(
        F.concat(F.substring(F.sha2(said.cast("binary"), 256), 1, 32), F.lpad(F.hex(words), 16, "0"))
    )


def _words(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id``: turns by ``turn``, null first, ``pos`` from 1 without gaps.

    Null roles and texts are empty. Turns of the same place come in the order of their ids, so
    equal rows are interchangeable and each counts. Rows without a ``conv_id`` belong to no
    conversation and are left out. Other columns do not matter.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", turn_id(text("role"), text("text")).alias("turn_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("turn"), F.col("turn_id"), F.col("_row")]
    at = placed(written(rows, "turns"), "conv_id", order, "_at")
    return at.select("conv_id", (F.col("_at") + 1).alias("pos"), "turn_id")


def shared_openings(turns: DataFrame, members: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Each conversation with the opening of its family's head in place of its own.

    The head of conversation c is c - c % ``family``. With h the checksum of c's decimal text
    modulo ``most`` + 1, c becomes the head's first h turns (all if it has fewer, none if there
    is no head) and then its own turns after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    head = F.col("conv_id") - F.col("conv_id") % family
    openings = (
        turns.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most))
        .groupBy(F.col("conv_id").alias("_head"))
        .agg(F.collect_list(F.struct("pos", "turn_id")).alias("_all"))
    )
    own = members.select("conv_id", head.alias("_head"), h.alias("_h"))
    each = own.join(openings, "_head", "left").select(
        "conv_id", "_h",
        F.filter(F.coalesce("_all", F.array()), lambda t: t["pos"] <= F.col("_h")).alias("_opening"),
    )
    each = written(each, "openings")
    shift = F.col("_h") - F.size("_opening")
    rest = turns.join(each.select("conv_id", "_h", shift.alias("_less")), "conv_id")
    rest = rest.where(F.col("pos") > F.col("_h")).select(
        "conv_id", (F.col("pos") - F.col("_less")).alias("pos"), "turn_id"
    )
    return each.select("conv_id", F.inline("_opening")).unionByName(rest)


def _lane(lane: int, pos: Column, turn: Column) -> Column:
    """60 bits of a turn at its position, 0 where there is none."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(lane), pos, turn), 4)
    return F.when(turn.isNotNull(), bits).otherwise(F.lit(0)).cast("decimal(20,0)")


def _blocks(turns: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """One row a block: ``conv_id, k, a, b, before``, its turns ``t0..``, and of the whole
    conversation ``n_turns, n_words``. A conversation without turns has an empty block."""
    pos = F.col("pos").cast("long")
    turn = F.col("turn_id")
    cut = turns.groupBy("conv_id", F.expr(f"(pos - 1) div {width}").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_id"))).alias("_turns"),
        F.sum(_lane(1, pos, turn)).alias("sum_a"),
        F.sum(_lane(2, pos, turn)).alias("sum_b"),
        F.sum(_words(turn)).alias("sum_w"),
        F.count(F.lit(1)).alias("_n"),
    )
    cut = written(cut, "cut")
    whole = cut.groupBy("conv_id").agg(F.sum("_n").alias("n_turns"), F.sum("sum_w").alias("n_words"))
    keyed = sums_before(cut, ["conv_id"], "k", {"a": "sum_a", "b": "sum_b", "before": "sum_w"})
    columns = [F.get("_turns", F.lit(i))["turn_id"].alias(f"t{i}") for i in range(width)]
    number = lambda c: F.col(c).cast("decimal(38,0)").alias(c)
    full = keyed.join(whole, "conv_id").select(
        "conv_id", "k", number("a"), number("b"), F.col("before").cast("long").alias("before"),
        *columns, "n_turns", "n_words",
    )
    bare = members.join(whole.select("conv_id"), "conv_id", "left_anti").select(
        "conv_id",
        *[F.lit(0).cast(full.schema[c].dataType).alias(c) for c in ("k", "a", "b", "before")],
        *[F.lit(None).cast("binary").alias(f"t{i}") for i in range(width)],
        *[F.lit(0).cast("long").alias(c) for c in ("n_turns", "n_words")],
    )
    return written(full.unionByName(bare), "blocks")


def _node(depth: Column, width: int, last: bool) -> Column:
    """The key of the node that the turn columns end in, or of its parent."""
    sums = []
    for lane, start in ((1, "a"), (2, "b")):
        total = F.col(start)
        for i in range(width):
            turn = F.col(f"t{i}")
            if not last:
                after = F.col(f"t{i + 1}") if i + 1 < width else F.lit(None)
                turn = F.when(after.isNotNull(), turn)
            pos = F.col("k") * width + (i + 1)
            total = (total + _lane(lane, pos.cast("long"), turn)).cast("decimal(38,0)")
        sums.append(total.cast("string"))
    return F.concat_ws(":", depth.cast("string"), *sums)


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """All nodes: ``depth, node, parent, words_before`` and the sums."""
    turns = ", ".join(f"t{i}" for i in range(width))
    grouped = rows.sparkSession.sql(
        f"SELECT k, a, b, before, {turns}, {width} - bit_count(grouping_id()) AS level, {sums} "
        f"FROM {{rows}} GROUP BY k, a, b, before, ROLLUP({turns})",
        rows=rows,
    )
    here = F.get(F.array(*[F.col(f"t{i}") for i in range(width)]), F.col("level") - 1)
    root = (F.col("level") == 0) & (F.col("k") == 0)
    # Levels beyond a conversation's last turn repeat its last node, a later block's level 0 the
    # node that keys it.
    nodes = grouped.where(root | ((F.col("level") > 0) & here.isNotNull()))
    depth = F.col("k") * width + F.col("level")
    words = F.col("before")
    for i in range(width - 1):
        words = words + F.when(F.col(f"t{i + 1}").isNotNull(), _words(F.col(f"t{i}"))).otherwise(0)
    made = [c for c in grouped.columns if c not in {"k", "a", "b", "before", "level", *turns.split(", ")}]
    return nodes.select(
        depth.alias("depth"),
        _node(depth, width, True).alias("node"),
        F.when(depth > 0, _node(depth - 1, width, False)).alias("parent"),
        words.alias("words_before"),
        *made,
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node out of its lists in order; a list is hashed as it comes."""
    node, state = None, None
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    for batch in batches:
        nodes, marks = [], []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    nodes.append(node)
                    marks.append(state.hexdigest())
                node, state = name, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(marks, pa.string())], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=schema)


def _ends(rows: DataFrame, width: int) -> DataFrame:
    """``node, ends_sha256`` of the nodes in which conversations end.

    Ids are listed in chunks of near ids first; a node's chunks are then hashed one by one.
    """
    begun = F.col("k") * width
    last = (F.col("n_turns") == 0) | ((F.col("n_turns") > begun) & (F.col("n_turns") <= begun + width))
    ended = rows.where(last).select("conv_id", _node(F.col("n_turns"), width, True).alias("node"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = ended.groupBy("node", F.expr(f"conv_id div {CHUNK}").alias("chunk")).agg(
        F.array_join(ids, ",").alias("ids")
    )
    ordered = chunks.repartition("node").sortWithinPartitions("node", "chunk")
    return ordered.mapInArrow(_digests, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie over the turns of all members.

    ``turns``: ``conv_id, pos, turn_id`` with ``pos`` from 1 without gaps (see
    ``ordered_turns``); ``members``: every ``conv_id`` once, those without turns too. A node is a
    sequence of first turns; the root has none and holds every member. Returned: ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of the subtree, itself included),
    ``saved_tokens`` (over the subtree, members but one times the words of the node's last turn) and
    ``ends_sha256`` (of the members that end here, ids ascending, joined by commas). Without members
    there is no node.
    """
    rows = _blocks(turns, members, width)
    owned = _rollup(rows, width, "min(conv_id) AS conv_id, max(n_turns) AS longest")
    owned = written(owned.withColumn("leaf", F.col("longest") == F.col("depth")), "owned")
    tops = owned.groupBy("conv_id").agg(
        F.min(F.struct("depth", "words_before", "parent")).alias("top"),
        F.max("depth").alias("end_depth"),
        F.max("leaf").cast("long").alias("leaf"),
    )
    tops = written(
        tops.select("conv_id", "end_depth", "leaf", F.col("top.depth").alias("top_depth"),
                    F.col("top.words_before").alias("shared"), F.col("top.parent").alias("parent")),
        "tops",
    )
    # Below the root, whose owner is one number, most parents have few children.
    root = owned.where("depth = 0").select("conv_id").first()
    openers = owned.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("opener"))
    deep = tops.where("top_depth > 1").join(openers, "parent")
    flat = tops.where("top_depth <= 1").withColumn(
        "opener", F.when(F.col("top_depth") == 1, F.lit(root and root["conv_id"])).cast("long")
    )
    owners = written(
        deep.unionByName(flat).select("conv_id", "end_depth", "leaf", "top_depth", "shared", "opener"),
        "owners",
    )
    facts = owners.select("conv_id", "leaf", "shared")
    # A member that owns no node shares all of its words.
    told = rows.join(facts, "conv_id", "left").withColumns(
        {"leaf": F.coalesce("leaf", F.lit(0)), "shared": F.coalesce("shared", "n_words")}
    )
    sums = (
        "min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(shared) AS _shared"
    )
    nodes = _rollup(told, width, sums)
    own = owners.select("conv_id", "end_depth", "top_depth", F.col("shared").alias("_own"), "opener")
    children = tops.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("_others")
    )
    joined = nodes.join(own, "conv_id").join(children, "node", "left").join(_ends(rows, width), "node", "left")
    goes_on = (F.col("end_depth") > F.col("depth")).cast("long")
    saved = F.col("_shared") - F.col("_own") - (F.col("n_convs") - 1) * F.col("words_before")
    return joined.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("top_depth"), F.col("conv_id"))
        .otherwise(F.col("opener"))
        .alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("_others", F.lit(0)) + goes_on).alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
