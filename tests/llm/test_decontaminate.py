"""Benchmark items in documents against brute force over all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from reviewsieve.llm import decontaminate, wordhash

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words_of(text):
    return wordhash.words([(text or "").lower()]).hash


def brute_force(docs, items, n=5, threshold=0.8):
    """(doc, item) -> best similarity over all windows of the item's size."""
    index = decontaminate.index_items([i for i in items if i[1]])
    out = {}
    for doc, text in docs:
        hashes = words_of(text)
        for at, item in enumerate(index.ids):
            size = min(int(index.size[at]), len(hashes))
            length = min(n, int(index.size[at]), len(hashes))
            if not length:
                continue
            shingles = wordhash.runs(hashes, length)
            span = size - length + 1
            if not index.shingles[at].keys() & set(shingles.tolist()):
                continue  # no window shares anything
            best = max(
                decontaminate.similarity(
                    Counter(shingles[s : s + span].tolist()), index.shingles[at], index.weight, index.usual
                )
                for s in range(len(hashes) - size + 1)
            )
            if best >= threshold - 1e-12:
                out[doc, item] = best
    return out


def corpus(seed=8):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(14, 60)))) for i in range(40)]
    items += [(100, "only three words"), (101, items[0][1]), (102, "!"), (103, None), (104, "a b c d e")]
    docs = []
    for i in range(150):
        body = [word() for _ in range(rng.randrange(1, 200))]
        if i % 3 == 0:
            own = rng.choice(items[:40])[1].split()
            for _ in range(i % 4):  # some changed words: both sides of the threshold
                own[rng.choice((0, 1, -1, -2, len(own) // 2))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((i, ", ".join(body).upper() if i % 2 else " ".join(body)))
    docs += [(1000, None), (1001, ""), (1002, "?!"), (1003, items[3][1]), (1004, "so only three words here"),
             (1005, "a b c d e"), (1006, " ".join(items[4][1].split()[:-3])), (None, items[5][1])]
    return docs, items


def found(spark, docs, items):
    rows = decontaminate.contaminated(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    ).collect()
    return rows, {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}


def test_equals_brute_force(spark):
    docs, items = corpus()
    rows, got = found(spark, docs, items)
    expected = brute_force(docs, items)
    assert got.keys() == expected.keys() and len(got) == len(rows)
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())
    assert (1004, 100) in got and (1005, 104) in got and (None, 5) in got and (1003, 3) in got


def test_place_of_the_window(spark):
    item = " ".join(f"i{n}" for n in range(20))
    rows, _ = found(spark, [(1, "x " * 30 + item + " y" * 30 + " " + item)], [(7, item)])
    assert [tuple(r) for r in rows] == [(1, 7, 30, 20, 1.0)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus(9)
    _, whole = found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 15)
    _, parts = found(spark, docs, items)
    assert {k for k in whole} == {k for k in parts}


def test_similarity_does_not_depend_on_blocks(spark, monkeypatch):
    common = " ".join(f"c{n}" for n in range(20))  # held by all items, so it weighs little
    items = [(i, common + " " + " ".join(f"i{i}x{n}" for n in range(20))) for i in range(12)]
    docs = [(i, "y " + " ".join(text.split()[:-1]) + " z") for i, text in items]
    _, whole = found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 3)
    _, parts = found(spark, docs, items)
    assert len(whole) == 12 and parts == pytest.approx(whole)


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "z", 4)], DOCS + ", item_id string, similarity int")
    items = spark.createDataFrame([(2, "a b c d e", 1)], ITEMS + ", doc_id int")
    assert [tuple(r)[:2] for r in decontaminate.contaminated(docs, items).collect()] == [(1, 2)]
    assert decontaminate.contaminated(docs.where("false"), items).count() == 0
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{rng.integers(500)}" for _ in range(30))) for i in range(50)]
    index = decontaminate.index_items(items, radius=20, parts=8)
    prints = []
    for _ in range(300):
        value = int(index.prints[rng.integers(50)])
        for bit in rng.choice(64, rng.integers(0, 25), replace=False):
            value ^= 1 << int(bit)
        prints.append(value)
    got = decontaminate.within_radius(index, 30, np.array(prints, np.uint64), 20, 8)
    expected = [
        (w, i) for w, p in enumerate(prints) for i in range(50)
        if (p ^ int(index.prints[i])).bit_count() <= 20
    ]
    assert got == expected


def test_fingerprints_at_the_threshold_lie_within_the_radius():
    rng = np.random.default_rng(7)
    far = 0
    for _ in range(400):
        common, a, b = np.split(rng.integers(0, 2**64, 40, np.uint64), [32, 36])  # similarity 0.8
        one, two = (
            decontaminate.fingerprint(decontaminate.simhash(np.concatenate((common, x)), np.ones(36))[-1])
            for x in (a, b)
        )
        far += (int(one) ^ int(two)).bit_count() > decontaminate.RADIUS
    assert far <= 2
