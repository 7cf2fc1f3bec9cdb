import pytest
from pyspark.sql import functions as F

from reviewsieve.functions.text import record_text
from reviewsieve.sources import articlexml as ax

HEAD = '<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet PUBLIC "-//X//Y" "https://nowhere.invalid/x.dtd">\n'
ARTICLES = HEAD + """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">1</PMID><Article>
<Journal><JournalIssue><PubDate><Year>2001</Year><Month>Feb</Month><Day>3</Day></PubDate></JournalIssue>
<Title>J &amp; K</Title></Journal>
<ArticleTitle>On <i>E. coli</i> growth</ArticleTitle>
<Abstract><AbstractText Label="A">first &lt;5<!-- c -->% <![CDATA[a<b]]></AbstractText><AbstractText>second</AbstractText></Abstract>
<AuthorList><Author><LastName>Roe</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pii">p</ArticleId><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="doi">10.1/b</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle><i>All</i> markup</ArticleTitle>
<Journal><PubDate><Year>1999</Year></PubDate></Journal></Article>
<OtherAbstract><AbstractText>elsewhere</AbstractText></OtherAbstract></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>3</PMID><Book><BookTitle>B</BookTitle></Book><Abstract><AbstractText>ba</AbstractText></Abstract></BookDocument></PubmedBookArticle>
</PubmedArticleSet>"""
BOOK = "<PubmedArticleSet><PubmedBookArticle><BookDocument><PMID>4</PMID><ArticleTitle>C</ArticleTitle></BookDocument></PubmedBookArticle></PubmedArticleSet>"


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame(
        [("r1", ARTICLES), ("r2", BOOK), ("r3", HEAD + "<eFetchResult><ERROR>bad ids</ERROR></eFetchResult>"),
         ("r4", "<PubmedArticleSet><PubmedArticle><PMID>5</PMID>"), ("r5", ""), ("r6", None),
         ("r7", "<PubmedArticleSet></PubmedArticleSet>")],
        "response string, xml string",
    )


def test_records_of_a_mixed_response(responses):
    rows = {r.pmid: r for r in ax.record_columns(ax.split_records(responses)).collect()}
    assert sorted(rows) == ["1", "2", "3", "4"]
    assert rows["1"].title == "On " and rows["1"].abstract == "first <5% a<b" and not rows["1"].is_book
    assert rows["2"].title is None and rows["2"].abstract == "Abstract not available"
    assert (rows["3"].title, rows["3"].book_title, rows["3"].abstract) == ("Chapter title not available", "B", "ba")
    assert (rows["4"].title, rows["4"].book_title) == ("C", "Book title not available")


def test_full_text_mode(responses):
    rows = {r.pmid: r for r in ax.record_columns(ax.split_records(responses), "full").collect()}
    assert rows["1"].title == "On E. coli growth" and rows["1"].abstract.endswith("second")
    assert rows["2"].title == "All markup"
    with pytest.raises(ValueError):
        ax.record_columns(responses, "none")


def test_rejects(responses):
    got = {r.response: r.reason for r in ax.rejected_responses(responses).collect()}
    assert got == {
        "r3": "error: bad ids", "r4": "not well formed", "r5": "not well formed", "r6": "not well formed"
    }


def test_citations(responses):
    rows = {r.pmid: r for r in ax.citation_columns(ax.split_records(responses)).collect()}
    one, two, three = rows["1"], rows["2"], rows["3"]
    assert one.authors == ["Roe, Ann", "Group"] and one.journal == "J & K"
    assert one.pubdate == "2001-Feb-3" and one.doi == "10.1/a"
    assert two.pubdate == "1999" and two.doi == "DOI not available" and two.journal is None
    assert three.pubdate is None and three.authors is None


def test_attributes_and_all_texts(responses):
    records = ax.split_records(responses)
    row = ax.attribute_columns(records, ["PMID", "Year", "Volume"]).where("PMID = '1'").first()
    assert (row.Year, row.Volume) == ("2001", "Volume not available")
    with pytest.raises(ValueError):
        ax.attribute_columns(records, ["a'] | //b"])
    texts = ax.all_tag_texts(records).select("texts")
    first = [r.texts for r in texts.collect() if r.texts.get("PMID") == "1"][0]
    assert first["AbstractText"] == "second" and first["ArticleId"] == "10.1/b" and "Journal" not in first


def test_files_requested_and_display(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLES)
    (tmp_path / "b.xml").write_text(BOOK)
    columns = ax.record_columns(ax.split_records(ax.read_responses(spark, str(tmp_path))))
    ids = spark.createDataFrame([("4",), ("1",), ("9",), ("1",)], "pmid string")
    got = ax.requested(columns, ids).orderBy("is_book", "seq").collect()
    assert [r.pmid for r in got] == ["1", "4"]
    shown = columns.select(
        "pmid", record_text(*[F.col(c) for c in ("is_book", "pmid", "title", "abstract", "book_title")]).alias("t")
    )
    text = {r.pmid: r.t for r in shown.collect()}
    assert text["1"] == "PMID: 1\nTitle: On \nAbstract: first <5% a<b"
    assert text["4"] == (
        "PMID: 4\nBook Title: Book title not available\nChapter Title: C\nAbstract: Abstract not available"
    )


def test_bulk_scan_of_one_tag(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLES.replace('<PMID Version="1">', "<PMID>"))
    schema = "MedlineCitation struct<PMID: string>"
    rows = ax.scan_records(spark, str(tmp_path), "PubmedArticle", schema)
    assert sorted(r[0] for r in rows.select("MedlineCitation.PMID").collect()) == ["1", "2"]
    books = ax.scan_records(spark, str(tmp_path), "PubmedBookArticle", "BookDocument struct<PMID: string>")
    assert [r[0] for r in books.select("BookDocument.PMID").collect()] == ["3"]


def test_fetch_plan_batches(spark):
    ids = spark.range(1, 2302).select(F.lit("T").alias("topic"), (F.col("id") * 37).alias("pmid"))
    ids = ids.union(ids.limit(5)).union(spark.createDataFrame([("U", 9), ("U", 8)], "topic string, pmid long"))
    plan = ax.fetch_plan(ids).orderBy("topic", "batch").collect()
    assert [(r.topic, r.batch, r.n_ids, r.method) for r in plan] == [
        ("T", 0, 1000, "POST"), ("T", 1, 1000, "POST"), ("T", 2, 301, "POST"), ("U", 0, 2, "GET")
    ]
    assert plan[3].id_list == "8,9" and plan[0].id_list.startswith("37,74,")


HOSTILE = [
    "plain text", "<a></a>junk", "<a></a></b>", "<a>x ]]> y</a>", "<a>\ufffe</a>", "<a>\x01</a>", "<a>&nbsp;</a>",
    "<a>&#1;</a>", "<a b=1/>", "<a b='1' b='2'/>", "<a><!-- x -- y --></a>", "<a><![CDATA[ x </a>", "<1/>",
    "<a>x < y</a>", "<a>b & c</a>", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>",
]


def test_hostile_responses_are_rejected_and_stop_nothing(spark):
    good = "\ufeff" + ARTICLES
    rows = [(f"bad{i}", xml) for i, xml in enumerate(HOSTILE)] + [("good", good)]
    responses = spark.createDataFrame(rows, "response string, xml string")
    rejects = {r.response for r in ax.rejected_responses(responses).collect()}
    assert rejects == {f"bad{i}" for i in range(len(HOSTILE))}
    assert ax.record_columns(ax.split_records(responses)).count() == 3


def test_full_text_keeps_words_that_markup_runs_through(spark):
    title = "CO<sub>2</sub> in H<sub>2</sub>O"
    xml = (
        f"<PubmedArticle><PMID>1</PMID><Article><ArticleTitle>{title}</ArticleTitle>"
        "<AbstractText>one</AbstractText><AbstractText>t<b>w</b>o</AbstractText></Article></PubmedArticle>"
    )
    responses = spark.createDataFrame([("r", xml)], "response string, xml string")
    row = ax.record_columns(ax.split_records(responses), "full").first()
    assert (row.title, row.abstract) == ("CO2 in H2O", "one two")


def test_commented_records_are_no_records(spark):
    one = "<PubmedArticle><PMID>{}</PMID></PubmedArticle>"
    xml = (
        f"<?xml version='1.0'?><!-- {one.format(1)} --><!DOCTYPE s><s>{one.format(2)}<!-- {one.format(3)} -->"
        f"<PubmedArticle><PMID>4</PMID><Article><ArticleTitle><![CDATA[<!-- a --> <!DOCTYPE x>]]></ArticleTitle>"
        "</Article></PubmedArticle></s>"
    )
    responses = spark.createDataFrame([("r", xml)], "response string, xml string")
    rows = ax.record_columns(ax.split_records(responses)).collect()
    assert [(r.pmid, r.title) for r in rows] == [("2", ax.NO_TITLE), ("4", "<!-- a --> <!DOCTYPE x>")]


def test_authors_of_all_places(spark):
    author = "<AuthorList><Author><LastName>{}</LastName></Author></AuthorList>"
    xml = (
        f"<PubmedBookArticle><BookDocument><PMID>1</PMID><Book>{author.format('E')}{author.format('F')}</Book>"
        f"{author.format('A')}</BookDocument></PubmedBookArticle><PubmedArticle><PMID>2</PMID></PubmedArticle>"
    )
    responses = spark.createDataFrame([("r", xml)], "response string, xml string")
    rows = {r.pmid: r.authors for r in ax.citation_columns(ax.split_records(responses)).collect()}
    assert rows == {"1": ["E", "F", "A"], "2": None}


def test_tag_texts_follow_the_parsed_tree(spark):
    from xml.etree import ElementTree

    xml = (
        "<PubmedArticle k='a>b'><PMID>1</PMID><e/><e>x &amp; &#233; &lt;<i>in</i> tail</e><v> \u2003 </v>"
        "<e a=\"1\">last</e><self k='v'/>after<q>\n</q></PubmedArticle>"
    )
    responses = spark.createDataFrame([("r", xml)], "response string, xml string")
    got = ax.all_tag_texts(ax.split_records(responses)).first().texts
    expected = {}
    for node in ElementTree.fromstring(xml).iter():
        if node.text and node.text.strip():
            expected[node.tag] = node.text
    assert got == expected


def test_a_record_is_cut_up_once_for_all_its_tags(spark):
    records = spark.createDataFrame([("<a><b>x</b><c>y &amp; z</c><b>w</b></a>",)], "xml string")
    rows = ax.all_tag_texts(records).select(F.explode("texts").alias("tag", "text"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # Tags and texts are two patterns; Spark copies them to a filter on the map's size and one on null.
    assert plan.count("regexp_extract_all") <= 6
    assert {tuple(r) for r in rows.collect()} == {("b", "w"), ("c", "y & z")}
