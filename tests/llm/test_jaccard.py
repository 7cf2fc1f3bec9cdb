"""The similarity join against brute force over all pairs, and its unusual inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import jaccard, wordhash
from reviewsieve.llm.components import components
from reviewsieve.llm.frames import table

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def shingles(text, n=5):
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if wordhash.word_char(c):
            word += c
        elif word:
            words.append(word)
            word = ""
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_force(rows):
    """doc_id -> (class_id, n_copies, n_links)."""
    sets = [(doc, shingles(text)) for doc, text in rows]
    links = {doc: set() for doc, _ in sets}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            links[a].add(b)
            links[b].add(a)
    out = {}
    for doc, own in sets:
        group, todo = {doc}, [doc]
        while todo:
            for other in links[todo.pop()] - group:
                group.add(other)
                todo.append(other)
        copies = sum(own == other for _, other in sets) if own else 1
        out[doc] = (min(group), copies, len(links[doc]))
    return out


def found(spark, rows, **kw):
    result = jaccard.similarity_classes(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in result}


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_planted_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # large families take several blocks
    rng = random.Random(5)
    rows = []
    for group, size in enumerate((1, 2, 3, 60, 8)):
        base = [f"b{group}x{i}" for i in range(120)]
        rows += [near(rng, base, rng.randrange(4)) for _ in range(size)]
    rows += [rows[0], rows[4], rows[4].upper(), "one two", "One, two!", "three"]
    rows = list(enumerate(rows))
    assert found(spark, rows) == brute_force(rows)


def chains(rng, count, length):
    """Texts that link to the one before and after only, under shuffled ids."""
    rows = []
    for c in range(count):
        long = [f"c{c}x{i}" for i in range(100 + 8 * length)]
        rows += [" ".join(long[8 * i : 8 * i + 100]) for i in range(length)]
    ids = rng.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("block", [512, 8])  # one block; several blocks
def test_chains_of_shuffled_ids_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = chains(random.Random(block), 4, 25)
    expected = brute_force(rows)
    assert max(n for _, _, n in expected.values()) == 2
    assert found(spark, rows) == expected


def test_given_documents_equal_brute_force(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_force(rows)
    assert found(spark, rows) == expected
    assert any(v[2] for v in expected.values())


def test_unusual_rows(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, "!? ."), (None, text), (5, text), (6, text), (7, "x " * 60_000)]
    got = found(spark, rows)
    assert got[1] == (1, 1, 0) and got[2] == (2, 1, 0) and got[3] == (3, 1, 0)
    assert got[None] == (None, 1, 0)
    assert got[5] == (5, 2, 1) and got[6] == (5, 2, 1)
    assert got[7] == (7, 1, 0)


def test_repeated_rows_empty_table_and_extra_columns(spark):
    text = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(4, text), (4, text), (9, "a b c d e f")], SCHEMA)
    docs = docs.withColumns({"class_id": F.lit("x"), "node": F.lit(1), "family": F.lit(2)})
    rows = sorted(tuple(r) for r in jaccard.similarity_classes(docs).collect())
    assert rows == [(4, 4, 2, 1), (4, 4, 2, 1), (9, 9, 1, 0)]
    empty = jaccard.similarity_classes(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "class_id", "n_copies", "n_links"]


def test_texts_that_share_a_doc_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(3, one), (5, one + " more"), (5, two), (5, three), (-7, three + " more"), (5, two)]
    got = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in jaccard.similarity_classes(got).collect())
    assert got == [(-7, -7, 1, 1), (3, 3, 1, 1), (5, -7, 1, 1), (5, 3, 1, 1), (5, 5, 2, 1), (5, 5, 2, 1)]


def test_bands_reach_their_recall():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(300):
        common, a, b = np.split(rng.integers(0, 2**64, 250, np.uint64), [200, 225])
        one, two = (np.unique(np.concatenate((common, x))) for x in (a, b))  # similarity 0.8
        hits += bool((jaccard.band_hashes(one) == jaccard.band_hashes(two)).any())
    assert hits >= 297


def test_counts_in_slices_equal_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", 50)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert (jaccard.shared_counts(sets[:4], sets[4:]) == expected).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]  # a long chain
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in root if any(a != b and n in (a, b) for a, b in edges)}
