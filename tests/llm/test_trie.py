"""Prefix tries against a trie of dictionaries."""

import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def sequences(rows):
    """Per conversation its (role, text) turns in order, ties by the digest of the turn."""
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[conv_id].append(((turn is not None, turn or 0, mark), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(plain):
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        out[c] = plain.get(head, [])[:h] + turns[h:]
    return out


def plain_trie(members):
    """The rows of the trie, node by node from the deepest up."""
    at = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in at:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(at, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(at[node]) - 1) * words + sum(saved[c] for c in children[node])
        ends = sorted(c for c in at[node] if len(members[c]) == len(node))
        out.append((
            min(at[node]), len(node), min(at[node[:-1]]) if node else None, len(at[node]),
            len(children[node]), leaves[node], saved[node],
            sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def trie_of(spark, rows, width, openings=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("k", F.lit("x"))
    turns = trie.ordered_turns(df.repartition(5))
    members = turns.select("conv_id").distinct()
    if openings:
        turns = trie.shared_openings(turns, members)
    return trie.prefix_trie(turns, members, width)


def same(got, want):
    key = lambda r: (r[1], r[0])
    return sorted(map(tuple, got.select(COLUMNS).collect()), key=key) == sorted(want, key=key)


def some(seed, n=60, longest=9, texts=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(200, n, replace=False).tolist():
        for t in range(rng.integers(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "word " * int(rng.integers(0, texts))))
    return rows


@pytest.mark.parametrize("width", [2, 8])
def test_random_conversations(spark, width):
    rows = some(width)
    assert same(trie_of(spark, rows, width), plain_trie(rebuilt(sequences(rows))))


ODD = [
    (None, 1, "user", "nobody"), (40, None, None, None), (40, None, "user", "x"), (40, 3, "", "a\x1cb  é"),
    (40, 3, "user", "tie"), (40, 3, "user", "tie"), (40, 3, "assistant", "tie"), (41, 2, "user", "x" * 100_000),
    (-5, 1, "a", "b"), (-20, 1, "a", "b"), (-20, 2, "a", "c"), (7, 1, "us", "erx"), (8, 1, "user", "x"),
    (9223372036854775807, 1, "user", "x"), (43, 1, "user", "x"), (62, 1, "user", "x"),
]


def test_nulls_ties_repeats_and_long_texts(spark):
    # Roles and texts that read alike when joined are different turns.
    long = [(100, t, "user", f"turn {t}") for t in range(90)]
    copies = [(c, t, "user", f"turn {t}") for c in (101, 107, 300) for t in range(33)]
    rows = ODD + long + copies
    for openings in (True, False):
        plain = sequences(rows)
        want = plain_trie(rebuilt(plain) if openings else plain)
        assert same(trie_of(spark, rows, 8, openings), want)


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(c, t, "user", "hi there") for c in range(0, 4000, 7) for t in range(3)]
    assert same(trie_of(spark, rows, 2, False), plain_trie(sequences(rows)))


def test_empty_table(spark):
    assert trie_of(spark, [], 8).count() == 0
    assert trie_of(spark, [(None, 1, "user", "x")], 8).count() == 0
