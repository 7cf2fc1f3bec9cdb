"""Records of one tag out of large XML files, each file read by many tasks.

Spark's own text reader cuts files into byte ranges and gives every task whole pieces between end
tags of the record, whatever store the files are in. An end tag may stand in a comment or a CDATA
section, though, and whether it does depends on all that comes before it in the file. So a first
pass notes for each range where it leads from each state (text, comment, CDATA), the ranges of a
file are chained, and the second pass starts every range in its true state. Only where a range begins
inside a comment or CDATA are its first and the earlier range's last pieces stitched together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.session import broadcast_if_small, cut_lineage

TEXT, COMMENT, CDATA = 0, 1, 2
_OPEN = re.compile(r"<!--|<!\[CDATA\[")
_CLOSE = {COMMENT: "-->", CDATA: "]]>"}
# Bytes of pieces that reach a Python task at once; a longer record comes alone.
BATCH_BYTES = 16 * 1024 * 1024


def state_after(text: str, state: int) -> int:
    """Where a text leads that begins in a state."""
    at = 0
    while True:
        if state == TEXT:
            found = _OPEN.search(text, at)
            if not found:
                return TEXT
            state, at = (COMMENT if found.group() == "<!--" else CDATA), found.end()
        else:
            at = text.find(_CLOSE[state], at)
            if at < 0:
                return state
            at, state = at + 3, TEXT


def record_finder(tag: str) -> Callable[[str], list[str]]:
    """The records of a text that begins outside of comments and CDATA, in order."""
    name = re.escape(tag)
    tokens = re.compile(
        rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<{name}(?=[\s>/])[^>]*>|</{name}\s*>", re.S
    )

    def find(text: str) -> list[str]:
        out, begin = [], None
        for token in tokens.finditer(text):
            said = token.group()
            if said.startswith("<!") or said.endswith("/>"):
                continue
            if said.startswith("</"):
                if begin is not None:
                    out.append(text[begin : token.end()])
                begin = None
            elif begin is None:
                begin = token.start()
        return out

    return find


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The pieces of a task, range by range."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: (r["response"], r["begin"]))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: where it leads from each state, its bytes and pieces."""
    for (response, begin), rows in _ranges(batches):
        leads, size, pieces = [TEXT, COMMENT, CDATA], 0, 0
        for row in rows:
            leads = [state_after(row["value"], s) for s in leads]
            size += len(row["value"].encode())
            pieces += 1
        out = {"response": response, "begin": begin, "size": row["size"], "leads": leads}
        yield pa.RecordBatch.from_pylist([out | {"bytes": size, "pieces": pieces}], _SURVEY)


_SURVEY = pa.schema(
    [("response", pa.string()), ("begin", pa.int64()), ("size", pa.int64()),
     ("leads", pa.list_(pa.int32())), ("bytes", pa.int64()), ("pieces", pa.int64())]
)
_SPECIAL = pa.schema(
    [("response", pa.string()), ("begin", pa.int64()), ("state", pa.int32()), ("crossed", pa.bool_()),
     ("open_end", pa.bool_())]
)


def _chain(end_tag: str):
    """The ranges of a file that are not plain: begun or ended inside something, or cut off."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("begin").to_pylist()
        size = rows[0]["size"]
        # Every piece but an unended last one has its end tag behind it.
        ended = sum(r["bytes"] + len(end_tag) * r["pieces"] for r in rows) <= size
        out, state = [], TEXT
        for i, row in enumerate(rows):
            after = row["leads"][state]
            last = i == len(rows) - 1
            mark = {"state": state, "crossed": after != TEXT and not last, "open_end": last and not ended}
            if state != TEXT or mark["crossed"] or mark["open_end"]:
                out.append({"response": row["response"], "begin": row["begin"]} | mark)
            state = after
        return pa.Table.from_pylist(out, _SPECIAL)

    return run


_FOUND = pa.schema(
    [("response", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()),
     ("xml", pa.string())]
)


def _cut(tag: str):
    """Records of each range (``whole``), and the pieces that belong to a record across a border."""
    find, end_tag = record_finder(tag), f"</{tag}>"

    def of_range(rows: Iterator[dict]) -> Iterator[tuple[bool, str]]:
        row = next(rows)
        crossed, open_end = bool(row["crossed"]), bool(row["open_end"])
        state, held = row["state"] or TEXT, ""
        head = state != TEXT
        while row is not None:
            following = next(rows, None)
            held += row["value"]
            state = state_after(row["value"], state)
            if following is not None or not open_end:
                held += end_tag
                if state == TEXT:
                    yield from ((not head, xml) for xml in ([held] if head else find(held)))
                    held, head = "", False
            row = following
        # Behind the last end tag, or in a comment or section that goes on in the next range.
        if held:
            yield from ((not (head or crossed), xml) for xml in ([held] if head or crossed else find(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for (response, begin), rows in _ranges(batches):
            for n, (whole, xml) in enumerate(of_range(iter(rows))):
                ready.append({"response": response, "begin": begin, "n": n, "whole": whole, "xml": xml})
                size += len(xml)
                if size > BATCH_BYTES // 4:
                    yield pa.RecordBatch.from_pylist(ready, _FOUND)
                    ready, size = [], 0
        yield pa.RecordBatch.from_pylist(ready, _FOUND)

    return run


def _stitch(tag: str):
    """Records across borders of a file's ranges. Joined in order, what was left over begins
    outside of comments and sections and each record in it is whole."""
    find = record_finder(tag)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("begin", "ascending"), ("n", "ascending")]).to_pylist()
        records = find("".join(r["xml"] for r in rows))
        first = {k: rows[0][k] for k in ("response", "begin", "n")}
        return pa.Table.from_pylist([first | {"whole": True, "xml": x} for x in records], _FOUND)

    return run


def read_records(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    """``response`` (the file's path), ``begin`` (of the byte range it was found in) and ``xml`` of
    every record.

    Files are cut into ranges of ``spark.sql.files.maxPartitionBytes``. What stands in comments or
    CDATA sections is no record. A record without an end tag, at the end of a cut-off file, is
    left out. Files are in UTF-8; the pieces between two end tags fit a task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    end_tag = f"</{tag}>"
    pieces = spark.read.option("lineSep", end_tag).text(paths).select(
        F.col("_metadata.file_path").alias("response"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )
    ranges = pieces.mapInArrow(
        _survey,
        "response string, begin long, size long, leads array<int>, bytes long, pieces long",
    )
    special = cut_lineage(
        ranges.groupBy("response").applyInArrow(
            _chain(end_tag),
            "response string, begin long, state int, crossed boolean, open_end boolean",
        )
    )
    marked = pieces.drop("size").join(broadcast_if_small(special), ["response", "begin"], "left")
    schema = "response string, begin long, n long, whole boolean, xml string"
    found = marked.mapInArrow(_cut(tag), schema)
    if special.where("crossed").limit(1).count():
        found = cut_lineage(found)
        across = found.where("not whole").groupBy("response").applyInArrow(_stitch(tag), schema)
        found = found.where("whole").unionByName(across)
    return found.select("response", "begin", "xml")


def scan_records(spark: SparkSession, paths: str | list[str], tag: str, schema: str) -> DataFrame:
    """Typed columns of every record of one tag; see ``read_records``. A broken record is null."""
    parsed = F.from_xml("xml", schema, {"mode": "PERMISSIVE"}).alias("record")
    return read_records(spark, paths, tag).select(parsed).select("record.*")
