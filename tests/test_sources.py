import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reviewsieve.operators import enrichment
from reviewsieve.operators.enrichment import enrich_judgements, with_later_records, without_record
from reviewsieve.session import cut_lineage
from reviewsieve.sources import qrels, sinks, topics, wordvectors


def test_qrels_files_and_rejects(spark, tmp_path):
    (tmp_path / "a.qrels").write_text("CD1 0 11 1\n  CD1\t0\t12\t0 \n\nCD1 0 13\n")
    (tmp_path / "b.qrels").write_text("CD2 0 14 2\nCD2 0 15 1 x\nCD2 0 16 yes\n")
    (tmp_path / "c.txt").write_text("CD9 0 1 1\n")
    lines = qrels.read_qrels_lines(spark, str(tmp_path))
    good = sorted(tuple(r) for r in qrels.judgements(lines).collect())
    assert good == [("a", "CD1", 0, 11, 1), ("a", "CD1", 0, 12, 0), ("b", "CD2", 0, 14, 2)]
    reasons = sorted(r.reason for r in qrels.rejected_lines(lines).collect())
    assert reasons == ["columns: 3", "columns: 5", "label is no whole number"]
    assert sorted(r.cd for r in qrels.topics(qrels.judgements(lines)).collect()) == ["CD1", "CD2"]
    assert qrels.of_topic(qrels.judgements(lines), "CD2").count() == 1


def test_topic_csv_last_value_first_place(spark, tmp_path):
    path = tmp_path / "CD1.csv"
    path.write_text(
        "CD,Misc,PMID,label,title,abstract\n"
        'CD1,0,5,1,"a, ""b""","two\nlines"\n'
        "CD1,0,6,0,,\n"
        "CD1,0,5,0,late,\n"
    )
    rows = topics.topic_articles(topics.read_topic_csv(spark, str(path))).orderBy("first_seq").collect()
    assert [(r.pmid, r.title, r.abstract, r.label) for r in rows] == [("5", "late", "", 0), ("6", "", "", 0)]
    one = topics.read_topic_csv(spark, str(path)).where("label = '1'").first()
    assert (one.title, one.abstract) == ('a, "b"', "two\nlines")


def test_topic_csv_bad_label_and_missing_file(spark, tmp_path):
    path = tmp_path / "CD1.csv"
    path.write_text("CD,Misc,PMID,label,title,abstract\nCD1,0,5,maybe,,\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        topics.topic_articles(topics.read_topic_csv(spark, str(path))).collect()
    with pytest.raises(AnalysisException):
        topics.read_topic_csv(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_enrichment_last_record_wins_everywhere(spark, hot_rows):
    judged = spark.createDataFrame(
        [("A", 0, 1, 1), ("B", 0, 1, 0), ("A", 0, 2, 0), ("C", 0, 3, 1), ("C", 0, 3, 1), ("D", 0, 3, 0)],
        "cd string, misc int, pmid long, label int",
    )
    records = spark.createDataFrame(
        [("1", "old", "x", 1), ("1", "new", "y", 9), ("2", "t2", None, 4), ("7", "t7", "z", 5)],
        "pmid string, title string, abstract string, seq long",
    )
    out = enrich_judgements(judged, records, hot_rows=hot_rows)
    got = sorted(tuple(r) for r in out.select("cd", "pmid", "label", "title").na.fill("-").collect())
    assert got == [
        ("A", "1", 1, "new"), ("A", "2", 0, "t2"), ("B", "1", 0, "new"),
        ("C", "3", 1, "-"), ("C", "3", 1, "-"), ("D", "3", 0, "-"),
    ]
    assert without_record(out).count() == 3


@pytest.mark.parametrize("limit", [50_000, 1])
def test_later_batches_equal_the_whole_join(spark, monkeypatch, capsys, limit):
    monkeypatch.setattr(enrichment, "BATCH_RECORDS", limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    judged = spark.createDataFrame([(f"T{i % 3}", 0, i % 40, i % 2) for i in range(100)], "cd string, misc int, pmid long, label int")
    rows = [(str(i % 50), f"t{i}" if i % 7 else None, f"a{i}", (i * 37) % 101) for i in range(90)]
    records = spark.createDataFrame(rows, "pmid string, title string, abstract string, seq long").where("seq <> 5")
    try:
        now = enrich_judgements(judged, records.where("seq % 3 = 0"), keep_seq=True)
        for part in ("seq % 3 = 1", "seq % 3 = 2", "false", "seq < 20"):
            before = cut_lineage(now)
            now = with_later_records(before, records.where(part))
            if limit > 1:
                now.explain()
                assert "Exchange hashpartitioning" not in capsys.readouterr().out
        key = lambda r: str(tuple(r))
        whole = enrich_judgements(judged, records, keep_seq=True)
        assert sorted(now.collect(), key=key) == sorted(whole.collect(), key=key)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sinks_by_topic_and_combined(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s1", "A", "1", "x, y"), ("s1", "B", "2", 'q "z"\nw'), ("s2", "A", "3", None)],
        "source_set string, cd string, pmid string, title string",
    )
    for fmt in ("csv", "parquet"):
        folder = str(tmp_path / fmt)
        sinks.write_by_topic(rows, folder, ["source_set", "cd"], fmt)
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        back = reader.format(fmt).load(folder)
        assert back.count() == 3
        assert back.where("source_set = 's1' and cd = 'B'").first().title == 'q "z"\nw'
    sinks.write_combined(rows, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3


def test_large_topics_are_written_to_several_files(spark, tmp_path):
    rows = spark.range(400).select(
        F.when(F.col("id") < 380, "large").when(F.col("id") < 390, "small").alias("CD"),
        F.col("id").cast("string").alias("PMID"), F.repeat(F.lit("text\n"), 200).alias("title"),
    )
    sinks.write_by_topic(rows, str(tmp_path / "topics"), ["CD"], max_bytes=40_000)

    def sizes(topic):
        return [f.stat().st_size for f in (tmp_path / "topics" / f"CD={topic}").glob("part-*")]

    assert len(sizes("large")) >= 5 and max(sizes("large")) < 200_000
    assert len(sizes("small")) == len(sizes("__HIVE_DEFAULT_PARTITION__")) == 1
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    back = reader.csv(str(tmp_path / "topics"))
    assert sorted(int(r.PMID) for r in back.collect()) == list(range(400))


@pytest.fixture
def keeper(spark, tmp_path):
    """Calls of kept_features on one folder, with a list of what was built."""
    built = []

    def keep(folder="kept", params=None, vectors=2, fail=False):
        def build():
            built.append(1)
            if fail:
                return spark.range(3).select(F.raise_error(F.lit("lost")).alias("id"))
            return spark.range(3)

        words = spark.range(vectors).withColumn("word", F.lit("w"))
        inputs = {"rows": spark.range(5)}
        return sinks.kept_features(spark, str(tmp_path / folder), params or {"width": 4}, build, words, inputs)

    keep.built = built
    return keep


def test_kept_features(keeper):
    first, again = keeper(), keeper()
    assert len(keeper.built) == 1
    assert first.features.count() == again.features.count() == 3 and again.vectorizer.count() == 2
    for other in ({"params": {"width": 5}}, {"vectors": 3}):
        with pytest.raises(ValueError, match="were built with"):
            keeper(**other)


@pytest.mark.parametrize("step", ["features", "vectorizer", "manifest"])
def test_a_writer_lost_on_its_way_keeps_nothing(spark, keeper, monkeypatch, tmp_path, step):
    if step == "features":
        with pytest.raises(Exception, match="lost"):
            keeper(fail=True)
    else:
        def lost(*args):
            raise RuntimeError("lost")

        with monkeypatch.context() as patch:
            patch.setattr(sinks, "_commit", lost)
            if step == "vectorizer":
                patch.setattr(sinks.uuid, "uuid4", lost)
            with pytest.raises(RuntimeError, match="lost"):
                keeper()
    assert not (tmp_path / "kept" / "manifest").exists()
    assert keeper().features.count() == 3 and keeper().vectorizer.count() == 2


def test_of_two_writers_the_first_counts(spark, keeper, monkeypatch):
    commit = sinks._commit

    def late(*args):
        monkeypatch.setattr(sinks, "_commit", commit)
        keeper()
        return commit(*args)

    monkeypatch.setattr(sinks, "_commit", late)
    kept = keeper()
    assert len(keeper.built) == 2 and kept.features.count() == 3
    assert kept.features.inputFiles() == keeper().features.inputFiles() and len(keeper.built) == 2


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, s string")
    assert sinks.fingerprint(df) == sinks.fingerprint(df.repartition(3))
    others = [df.distinct(), df.where("n = 1"), df.withColumn("s", F.lit("b")), df.limit(0)]
    assert len({sinks.fingerprint(d) for d in [df, *others]}) == 5


def test_word_vectors_as_text_and_parquet(spark, tmp_path):
    text = tmp_path / "v.txt"
    text.write_text("2 3\nalpha 1 0.5 -2\nbeta 1e-3 0 4 \n")
    read = wordvectors.read_word_vectors(spark, str(text), "text").orderBy("word").collect()
    assert [(r.word, [round(v, 4) for v in r.vector]) for r in read] == [
        ("alpha", [1.0, 0.5, -2.0]), ("beta", [0.001, 0.0, 4.0])
    ]
    wordvectors.read_word_vectors(spark, str(text), "text").write.parquet(str(tmp_path / "v"))
    assert wordvectors.read_word_vectors(spark, str(tmp_path / "v")).count() == 2


def test_partition_of_topic_is_pruned(spark, tmp_path, capsys):
    rows = spark.range(10).withColumn("cd", F.concat(F.lit("T"), (F.col("id") % 3).cast("string")))
    rows.write.partitionBy("cd").parquet(str(tmp_path / "t"))
    qrels.of_topic(spark.read.parquet(str(tmp_path / "t")), "T1").explain()
    assert "PartitionFilters: [isnotnull(cd" in capsys.readouterr().out
