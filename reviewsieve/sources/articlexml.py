"""Article XML: landed responses, records, their columns, and the plan to fetch them.

A response is one answer for at most ``FETCH_BATCH`` ids, so a response row and the
records cut from it are of bounded size. Everything runs in the JVM: ``from_xml`` tests
that a response is well formed, ``xpath`` reads the columns that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.functions.ranking import id_rank
from reviewsieve.sources.xmlscan import read_records, scan_records  # noqa: F401

# Record tags, default texts, and the limits of one fetch.
ARTICLE_TAG = "PubmedArticle"
BOOK_TAG = "PubmedBookArticle"
NO_ABSTRACT = "Abstract not available"
NO_TITLE = "Title not available"
NO_CHAPTER_TITLE = "Chapter title not available"
NO_BOOK_TITLE = "Book title not available"
NO_DOI = "DOI not available"
FETCH_BATCH = 1000
POST_ABOVE = 200

# A document type would make the XPath parser fetch it over the network; it goes together
# with the declaration, so that the rest can be put under one element of our own. Only what
# stands ahead of the first element is taken away.
_PROLOG = (
    r"(?s)^[\s\uFEFF]*(<\?xml[^>]*>)?(\s|<!--.*?-->)*"
    r"(<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>)?"
)
_COMMENT = r"(?s)<!--.*?-->"
# A start tag with its name, and the text up to the next tag; an empty-element tag has none.
_START_TAG = r"""<([^\s/>!?]+)(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?(?<!/)>([^<]*)"""
# Characters other than white space of any alphabet.
_SHOWN = r"[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
_AUTHOR = "array<struct<LastName: string, ForeName: string, CollectiveName: string>>"
_LISTS = f"AuthorList: array<struct<Author: {_AUTHOR}>>"
_AUTHORS = (
    f"MedlineCitation struct<Article: struct<{_LISTS}>>, Article struct<{_LISTS}>, "
    f"BookDocument struct<Book: struct<{_LISTS}>, {_LISTS}>"
)
# Where authors stand; those of the whole book come ahead of those of the chapter.
_AUTHOR_PLACES = (
    "MedlineCitation.Article", "Article", "BookDocument.Book", "BookDocument",
)


def read_responses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per landed response file: ``response`` (its path) and ``xml``."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("response"), F.col("value").alias("xml"))


def _checked(responses: DataFrame) -> DataFrame:
    """Responses under one root element, without comments, and whether they are broken.

    ``from_xml`` reads up to the end of the root: with a root of our own, that is all of it.
    """
    body = _without_cdata(F.col("_body"))
    whole = F.concat(F.lit("<response>"), F.col("_body"), F.lit("</response>"))
    parsed = F.from_xml(whole, "_corrupt string", _PARSE)
    # What from_xml lets pass but XPath or the reader of a response would not.
    framed = F.rlike("_body", F.lit(r"(?s)^\s*<.*>\s*$"))
    stray = F.rlike("_body", F.lit(r"[\uFFFE\uFFFF]|\]\]>"))
    broken = F.col("_body").isNull() | ~framed | stray | parsed["_corrupt"].isNotNull()
    # Every step in a column of its own, which Spark makes once.
    bare = responses.withColumn("_body", F.regexp_replace("xml", _PROLOG, "")).withColumn("_body", body)
    shown = F.regexp_replace(whole, _COMMENT, "")
    return bare.withColumn("_broken", broken).withColumn("xml", shown).drop("_body")


def _without_cdata(xml: Column) -> Column:
    """CDATA sections as escaped text, for XPath gives only the first of two text pieces."""
    pieces = F.split(xml, r"<!\[CDATA\[")

    def plain(piece: Column, i: Column) -> Column:
        raw = F.substring_index(piece, "]]>", 1)
        escaped = F.replace(F.replace(raw, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        rest = F.substr(piece, F.length(raw) + F.lit(4))
        return F.when(i == 0, piece).otherwise(F.concat(escaped, rest))

    joined = F.array_join(F.transform(pieces, plain), "")
    return F.when(F.contains(xml, F.lit("<![CDATA[")), joined).otherwise(xml)


def _has_error() -> Column:
    """Whether there is an ``ERROR`` element; most texts do not even hold its name."""
    named = F.contains("xml", F.lit("<ERROR"))
    return F.when(named, F.xpath_boolean("xml", F.lit("boolean(//ERROR)"))).otherwise(False)


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Responses that are no XML or carry an ``ERROR`` element, each with the reason."""
    error = F.xpath_string("xml", F.lit("(//ERROR)[1]"))
    reason = F.when(F.col("_broken"), F.lit("not well formed")).when(
        _has_error(), F.concat(F.lit("error: "), error)
    )
    checked = _checked(responses).withColumn("reason", reason)
    return checked.where("reason is not null").drop("_broken", "xml")


def split_records(responses: DataFrame) -> DataFrame:
    """Records of the good responses: ``is_book``, ``seq`` (place in its kind) and ``xml``."""
    xml = F.when(~F.col("_broken"), F.when(~_has_error(), F.col("xml")))
    others = [c for c in responses.columns if c != "xml"]

    def records(tag: str, is_book: bool) -> Column:
        found = F.regexp_extract_all("xml", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}\s*>"), F.lit(0))
        return F.transform(
            found,
            lambda x, i: F.struct(F.lit(is_book).alias("is_book"), i.alias("seq"), x.alias("xml")),
        )

    good = _checked(responses).withColumn("xml", xml)
    both = F.concat(records(ARTICLE_TAG, False), records(BOOK_TAG, True))
    return good.select(*others, F.inline(both))


def first_text(tag_path: str, missing: Column) -> Column:
    """Text of the first such element up to its first child element.

    ``missing`` where there is no such element, null where it holds no such text. The
    element comes back as a null entry ahead of its texts, so one XPath call tells all; it
    is bound to a name (a list of one) so that it is made once.
    """
    found = F.xpath(
        "xml", F.lit(f"({tag_path})[1] | ({tag_path})[1]/text()[not(preceding-sibling::*)]")
    )
    value = F.transform(
        F.array(found),
        lambda f: F.when(F.size(f) == 0, missing).when(F.size(f) > 1, F.array_join(f, "")),
    )
    return F.get(value, F.lit(0))


def full_text(tag_path: str, missing: Column) -> Column:
    """All text of all such elements, one blank between elements, blanks collapsed.

    Markup inside an element does not part its text. The blank between elements is put in
    ahead of their end tags.
    """
    tag = tag_path.rpartition("/")[2]
    parted = F.replace("xml", F.lit(f"</{tag}"), F.lit(f" </{tag}"))
    found = F.xpath(parted, F.lit(f"{tag_path}//text()"))
    text = F.trim(F.regexp_replace(F.array_join(found, ""), r"\s+", " "))
    return F.when(F.size(found) == 0, missing).otherwise(text)


def record_columns(records: DataFrame, text_mode: str = "first") -> DataFrame:
    """``pmid, title, abstract, book_title`` beside ``is_book`` and the other columns."""
    if text_mode not in ("first", "full"):
        raise ValueError("text_mode is 'first' or 'full'")
    text = first_text if text_mode == "first" else full_text
    book = F.col("is_book")
    title = F.when(book, text("//BookDocument//ArticleTitle", F.lit(NO_CHAPTER_TITLE))).otherwise(
        text("//Article//ArticleTitle", F.lit(NO_TITLE))
    )
    abstract = F.when(book, text("//BookDocument//AbstractText", F.lit(NO_ABSTRACT))).otherwise(
        text("//Article//AbstractText", F.lit(NO_ABSTRACT))
    )
    return records.select(
        *[c for c in records.columns if c != "xml"],
        first_text("//PMID", F.lit(None)).alias("pmid"),
        title.alias("title"),
        abstract.alias("abstract"),
        F.when(book, text("//BookTitle", F.lit(NO_BOOK_TITLE))).alias("book_title"),
    )


def requested(columns: DataFrame, ids: DataFrame, pmid: str = "pmid") -> DataFrame:
    """Records of the asked ids only; order by ``is_book, seq`` to list articles first."""
    return columns.join(ids.select(pmid), pmid, "left_semi")


def citation_columns(records: DataFrame) -> DataFrame:
    """``authors, journal, pubdate, doi`` beside the record's other columns."""
    parsed = F.from_xml(F.col("xml"), _AUTHORS)
    none = F.expr("array()").cast(f"array<{_AUTHOR}>")
    lists = F.flatten(
        F.array(*[F.coalesce(f"_p.{p}.AuthorList.Author", none) for p in _AUTHOR_PLACES])
    )
    authors = F.flatten(F.filter(lists, lambda a: a.isNotNull()))
    name = lambda a: F.coalesce(
        a["CollectiveName"], F.concat_ws(", ", a["LastName"], a["ForeName"])
    )
    date = F.xpath(
        "xml", F.lit("(//PubDate)[1]/*[self::Year or self::Month or self::Day]/text()")
    )
    return records.withColumn("_p", parsed).select(
        *[c for c in records.columns if c != "xml"],
        first_text("//PMID", F.lit(None)).alias("pmid"),
        F.when(F.size(authors) > 0, F.transform(authors, name)).alias("authors"),
        first_text("//Journal/Title", F.lit(None)).alias("journal"),
        F.nullif(F.array_join(date, "-"), F.lit("")).alias("pubdate"),
        first_text("//ArticleId[@IdType='doi']", F.lit(NO_DOI)).alias("doi"),
    )


def attribute_columns(records: DataFrame, tags: list[str]) -> DataFrame:
    """One column per asked tag: its first text, or ``<tag> not available``."""
    for tag in tags:
        if not tag.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"no tag name: {tag!r}")
    return records.select(
        *[c for c in records.columns if c != "xml"],
        *[first_text(f"//{tag}", F.lit(f"{tag} not available")).alias(tag) for tag in tags],
    )


def all_tag_texts(records: DataFrame) -> DataFrame:
    """``texts``: a map from tag to the last text found under it, blank texts left out.

    An element's text goes up to its first child. Records are well formed and free of
    comments and CDATA here, so start tags and what follows them can be cut out by pattern.
    """
    part = lambda group: F.regexp_extract_all("xml", F.lit(_START_TAG), F.lit(group))
    plain = lambda text: F.when(
        F.contains(text, F.lit("&")),
        F.xpath_string(F.concat(F.lit("<t>"), text, F.lit("</t>")), F.lit("/t")),
    ).otherwise(text)
    pairs = F.zip_with(
        part(1), part(2), lambda tag, text: F.struct(tag.alias("tag"), plain(text).alias("text"))
    )
    shown = F.filter(pairs, lambda p: F.rlike(p["text"], F.lit(_SHOWN)))

    def last_texts(found: Column) -> Column:
        tags = F.array_distinct(F.transform(found, lambda p: p["tag"]))
        last = F.transform(
            tags, lambda tag: F.element_at(F.filter(found, lambda p: p["tag"] == tag), -1)["text"]
        )
        return F.map_from_arrays(tags, last)

    # Bound to a name (a list of one), so that a record is cut up once and not once for every tag,
    # wherever Spark copies the expression to.
    texts = F.get(F.transform(F.array(shown), last_texts), F.lit(0))
    others = [c for c in records.columns if c != "xml"]
    return records.select(*others, texts.alias("texts"))


def fetch_plan(ids: DataFrame, topic: str = "topic", pmid: str = "pmid") -> DataFrame:
    """Request batches of a topic's ids: ``(topic, batch, n_ids, method, id_list)``.

    Ids are whole numbers; each distinct id is asked for once per topic, in id order.
    """
    ranked = id_rank(ids.select(topic, pmid).distinct(), [topic], pmid)
    batches = ranked.groupBy(
        topic, F.floor((F.col("pos") - 1) / F.lit(FETCH_BATCH)).alias("batch")
    ).agg(
        F.count(F.lit(1)).alias("n_ids"),
        F.array_sort(F.collect_list(pmid)).alias("_ids"),
    )
    return batches.select(
        topic,
        "batch",
        "n_ids",
        F.when(F.col("n_ids") > POST_ABOVE, F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        F.array_join(F.transform("_ids", lambda i: i.cast("string")), ",").alias("id_list"),
    )
