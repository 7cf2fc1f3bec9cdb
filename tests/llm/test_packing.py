"""Packing against the tokenizer itself and against the rules of a packing."""

import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewsieve.llm import packing
from reviewsieve.llm.frames import table
from reviewsieve.llm.tokens import BatchTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


PLAIN, BATCH = Tokenizer.from_file(PATH), BatchTokenizer(PATH)


@pytest.fixture(scope="module")
def plain():
    return PLAIN


ODD = [
    "", "  ", "it's I'LL we've'd 'same ''s don't 12.5km ²³ x'ré", "ΣΣ İstanbul é Å",
    "<|endoftext|>a b", "\x1c\x1d a\u0085b c", "日本語 ١٢٣ \U0001f600!!'s", "'", "''", "..'s.'t 5's",
    "a" * 5000,
]


def test_ids_equal_the_tokenizer(plain):
    for texts in (ODD, ODD[::-1]):
        got = BatchTokenizer(PATH).ids(texts)
        expected = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
        assert [g.tolist() for g in got] == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_ids_of_any_text(texts):
    got = BATCH.ids(texts)
    assert [g.tolist() for g in got] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_characters_beyond_the_tables():
    points = [c for c in map(chr, range(0x20000)) if unicodedata.category(c) == "Cn"]
    texts = [f"ab{c}cd {c}{c} x" for c in points[::7]] + ["a\u1c89b", "\U000105c0 z"]
    assert [g.tolist() for g in BATCH.ids(texts)] == [
        x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)
    ]


def test_ids_of_long_words_with_one_sum_of_powers():
    """Words of 1024 and 2048 letters on a pattern that sums modulo a power of two cannot tell apart."""
    one = "a"
    other = "b"
    for _ in range(11):
        one, other = one + other, other + one
    texts = [f"{one} {other}", f"{other} x {one[:1024]} {other[:1024]}"]
    assert [g.tolist() for g in BatchTokenizer(PATH).ids(texts)] == [
        PLAIN.encode(t, add_special_tokens=False).ids for t in texts
    ]


def plain_fills(histogram, size):
    """Fills of the packs, piece by piece: longest first, into the shortest pack with room."""
    fills = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        room = [f for f in fills if f + length <= size]
        if room:
            fills.remove(min(room))
            fills.append(min(room) + length)
        else:
            fills.append(length)
    return sorted(fills)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=12))
def test_patterns_equal_packing_piece_by_piece(histogram):
    packs = packing.patterns(histogram, 60)
    assert sorted(sum(p) for count, p in packs for _ in range(count)) == plain_fills(histogram, 60)


def test_a_second_piece_goes_to_the_pack_that_is_shortest_then():
    assert sorted(packing.patterns({55: 1, 50: 1, 20: 2}, 100)) == [(1, (50, 20)), (1, (55, 20))]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 1000), max_size=30))
def test_patterns_use_every_piece_once(histogram):
    used = defaultdict(int)
    for count, lengths in packing.patterns(histogram, 64):
        assert count > 0 and 0 < sum(lengths) <= 64
        for n in lengths:
            used[n] += count
    assert used == {n: c for n, c in histogram.items() if c}


def test_slots_are_a_bijection():
    histogram = {60: 3, 33: 7, 20: 11, 9: 40, 1: 13}
    slots = packing.Slots(packing.patterns(histogram, 64))
    taken = set()
    for n, count in histogram.items():
        sequence, offset = slots.place(np.full(count, n), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            cells = {(s, o + i) for i in range(n)}
            assert not cells & taken
            taken |= cells
    assert max(c[1] for c in taken) < 64


def check_packing(rows, texts, plain, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = plain.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size


def test_given_documents(spark, plain):
    docs = table(spark, SF_DIR, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack_documents(docs, PATH).collect()
    check_packing(rows, texts, plain, 2048)
    tokens = sum(r["length"] for r in rows)
    sequences = len({r["sequence_id"] for r in rows})
    assert tokens / sequences / 2048 > 0.98


def test_cells_of_a_hot_length(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 7)
    texts = {i: "two words" for i in range(100)} | {100: None, 101: "", 102: "word " * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check_packing(packing.pack_documents(docs, PATH, 64).collect(), texts, plain, 64)


def test_unusual_tables(spark):
    schema = "doc_id bigint, text string, length string, sequence_id int, _rank int"
    empty = packing.pack_documents(spark.createDataFrame([], schema), PATH)
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    same = [(5, "a b", "x", 1, 1), (5, "a b", "x", 1, 1), (None, None, None, None, None)]
    rows = packing.pack_documents(spark.createDataFrame(same, schema), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (5, 3), (5, 3)]
    assert sorted(r["offset"] for r in rows) == [0, 3, 6]
