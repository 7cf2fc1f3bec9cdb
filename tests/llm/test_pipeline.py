"""The pipeline stage by stage, and its queries in the entry."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_decontaminate import brute_force as leaks_by_force
from test_jaccard import brute_force as groups_by_force
from test_packing import check_packing
from tokenizers import Tokenizer

import __spark_entry__ as entry
from reviewsieve.llm import queries
from reviewsieve.llm.frames import table

SF_DIR = "/root/testdata/sf0.01"


def test_stages_and_registration():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language identification", "toxicity", "n-gram Jaccard join",
                     "benchmark decontamination", "packing"]
    every = entry.queries()
    assert "pipeline" in every and set(queries.QUERIES) <= set(every)
    assert [sum(q.startswith(f"op{n}_") for q in every) for n in range(1, 11)] == [1] * 10
    assert set(queries.ORACLES) <= set(every)


def test_every_stage_on_its_own_input(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == columns
        kept = kept.checkpoint()
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        gone = set(before) - after
        assert kept.count() == len(after) and after <= set(before)
        if name == "n-gram Jaccard join":
            groups = groups_by_force(list(before.items()))
            assert after == {d for d, (group, _, _) in groups.items() if d == group}
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
            assert gone == {doc for doc, _ in leaks_by_force(list(before.items()), items)} and gone
        elif name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF_DIR, "labels").collect()}
            clean = [d for d in before if labels.get(d) == 0]
            toxic = [d for d in before if labels.get(d) == 1]
            assert sum(d in gone for d in clean) <= 0.02 * len(clean)
            assert sum(d in gone for d in toxic) >= 0.8 * len(toxic)
        else:
            assert len(gone) <= 0.02 * len(before)
        docs = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packing(rows, texts, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 2048)


def test_stages_take_unusual_rows(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id int"
    odd = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (None, "x y", "en", "s", 3, 3),
           (3, "!!", "en", "s", 2, 4), (4, "word " * 30_000, "en", "s", 1, 5)] * 2
    docs = spark.createDataFrame(odd, columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), SF_DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= len(odd)


def test_texts_that_share_a_doc_id_go_one_by_one(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(3, one), (5, one + " more"), (5, two), (5, two), (5, three), (6, two.upper()),
            (8, None), (8, None), (8, "!"), (None, two)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()]
    expected = [(3, one), (5, two), (5, three), (8, None), (8, "!"), (None, two)]
    assert sorted(left, key=str) == sorted(expected, key=str)
