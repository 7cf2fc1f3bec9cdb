"""Registered queries: SQL twins where there are any, result columns, folds."""

import zlib

import pytest

from compare import compare, connect
from reviewsieve.llm import queries

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_jaccard_join": ["doc_id", "class_id", "n_copies", "n_links"],
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_decontamination": ["doc_id", "item_id", "first_word", "n_words", "similarity"],
    "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op12_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op13_conversation_trie": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ],
    "op11_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op10_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name in queries.ORACLES:
        assert compare(spark, connect(SF_DIR), SF_DIR, name).startswith("same")
        return
    rows = df.collect()
    assert rows
    if "held_out" in df.columns:
        modulus, wanted = {"op3": (4, 2), "op7": (5, 0), "op1": (5, 1)}[name[:3]]
        assert all(
            r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == wanted) for r in rows
        )
