"""WARC archives as a Spark data source, and the archive of a table of pages.

Reading plans partitions from file sizes, reads the headers of a record first, and tests the
pushed filters on them. The block of an unwanted record is passed over: by its length in a
plain file, by the skip lengths of its gzip header in a compressed one.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from reviewsieve.llm.frames import bounded_batches, shared_folder, table, written
from reviewsieve.session import broadcast_if_small

# Fixed values of the format.
VERSION = "WARC/1.1"
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "record_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

SCHEMA = ", ".join(
    f"{name} {'bigint' if name == 'content_length' else 'string'}" for name in HEADERS
) + ", http_length bigint, payload binary"
ARROW_SCHEMA = pa.schema(
    [(n, pa.int64() if n == "content_length" else pa.string()) for n in HEADERS]
    + [("http_length", pa.int64()), ("payload", pa.binary())]
)
FILE_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
_READ = 64 * 1024


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# --- records as bytes ---------------------------------------------------------------------


def _value(text: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [VERSION]
    lines += [f"{k}: {_value(v)}" for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member whose header tells its own length (the extra field ``sl``)."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    extra = 12
    size = 10 + 2 + extra + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", extra)
    head += b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """Header names in lower case; a line that begins with a blank goes on with the last one."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _whole(block: bytes, size: int) -> bytes:
    if len(block) < size:
        raise ValueError(f"archive is cut off: a record of {size} bytes has {len(block)}")
    return block


class _Plain:
    """Records of an uncompressed file."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def head(self) -> bytes | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0 or not self.held.strip(b"\r\n"):
            more = self.file.read(_READ)
            if not more:
                return None
            self.held = (self.held + more).lstrip(b"\r\n")
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def block(self, size: int) -> bytes:
        while len(self.held) < size:
            more = self.file.read(max(_READ, size - len(self.held)))
            if not more:
                break
            self.held += more
        block, self.held = self.held[:size], self.held[size:].lstrip(b"\r\n")
        return _whole(block, size)

    def skip(self, size: int) -> None:
        if size > len(self.held):
            self.file.seek(self.file.tell() + size - len(self.held))
            self.held = b""
        else:
            self.held = self.held[size:]
        self.held = self.held.lstrip(b"\r\n")


class _Gzip:
    """Records of a file with one gzip member per record."""

    def __init__(self, file):
        self.file, self.begin = file, 0

    def head(self) -> bytes | None:
        self.file.seek(self.begin)
        self.input = self.file.read(_READ)
        if not self.input:
            return None
        self.length = None
        if self.input[3:4] == b"\x04" and self.input[12:14] == b"sl":
            self.length = struct.unpack("<I", self.input[16:20])[0]
        self.unpack, self.out, self.read = zlib.decompressobj(31), b"", len(self.input)
        while (end := self.out.find(b"\r\n\r\n")) < 0:
            if not self._more(4096):
                return None
        head, self.out = self.out[:end], self.out[end + 4 :]
        return head

    def _more(self, limit: int) -> bool:
        """Unpack up to ``limit`` further bytes; False at the member's end."""
        if self.unpack.eof:
            return False
        if not self.input:
            self.input = self.file.read(_READ)
            self.read += len(self.input)
            if not self.input:
                return False
        self.out += self.unpack.decompress(self.input, limit)
        self.input = b"" if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def block(self, size: int) -> bytes:
        while len(self.out) < size and self._more(max(_READ, size - len(self.out))):
            pass
        block = self.out[:size]
        self.skip(size)
        return _whole(block, size)

    def skip(self, size: int) -> None:
        if self.length is None:
            while self._more(1 << 20):
                self.out = b""
            self.length = self.read - len(self.input) - len(self.unpack.unused_data)
        self.begin += self.length


def _http_length(block: bytes, content_type: str) -> tuple[int | None, bytes]:
    """Payload length that an HTTP header states, and the payload of an HTTP block."""
    if not content_type.startswith("application/http"):
        return None, block
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = parse_headers(head).get("content-length", "")
    return (int(stated) if stated.isdigit() else None), payload


# --- the data source ----------------------------------------------------------------------


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.target = int(options.get("partitionbytes", FILE_BYTES))
        self.tests: list = []

    def pushFilters(self, filters):
        """Tests on headers are made here, before a block is read; others stay with Spark."""
        for test in filters:
            column = test.attribute[0] if hasattr(test, "attribute") else None
            if (
                isinstance(test, (EqualTo, In, IsNotNull, IsNull))
                and len(test.attribute) == 1
                and column in HEADERS
                and column != "content_length"
            ):
                value = getattr(test, "value", None)
                self.tests.append((type(test).__name__, column, value))
            else:
                yield test

    def partitions(self):
        store, base = _store(self.path)
        kind = store.get_file_info(base)
        found = [kind] if kind.type == fs.FileType.File else store.get_file_info(
            fs.FileSelector(base, recursive=True, allow_not_found=True)
        )
        files = sorted(
            (f.path, f.size)
            for f in found
            if f.type == fs.FileType.File and f.base_name[0] not in "._"
        )
        bins, size = [[]], 0
        for path, n in files:
            if bins[-1] and size + n > self.target:
                bins.append([])
                size = 0
            bins[-1].append(path)
            size += n
        return [_Files(b) for b in bins]

    def _wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            held = row[column]
            if kind == "EqualTo" and (held is None or held != value):
                return False
            if kind == "In" and held not in tuple(v for v in value if v is not None):
                return False
            if kind == "IsNotNull" and held is None or kind == "IsNull" and held is not None:
                return False
        return True

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                packed = file.read(2) == b"\x1f\x8b"
                file.seek(0)
                records = _Gzip(file) if packed else _Plain(file)
                while (head := records.head()) is not None:
                    headers = parse_headers(head)
                    row = {n: headers.get(h.lower()) for n, h in HEADERS.items()}
                    length = int(row["content_length"] or 0)
                    row["content_length"] = length
                    if not self._wanted(row):
                        records.skip(length)
                        continue
                    if self.payload or row["record_type"] == "revisit":
                        stated, payload = _http_length(
                            records.block(length), row["content_type"] or ""
                        )
                        row |= {"http_length": stated, "payload": payload}
                    else:
                        records.skip(length)
                    rows.append(row)
                    size += length + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes records; files get their names when all tasks are done."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = record_bytes(*_record(row))
                data = member(data) if self.gzip else data
                if out is None or size + len(data) > self.limit:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc{'.gz' * self.gzip}")
                    out, size = store.open_output_stream(f"{base}/_{files[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        store, base = _store(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{base}/_{name}", f"{base}/{name}")

    def abort(self, messages):
        store, base = _store(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.delete_file(f"{base}/_{name}")


def _record(row: dict) -> tuple[dict[str, str | None], bytes]:
    """Headers and block of a row of ``RECORDS``."""
    payload = row["payload"] or b""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": row["record_date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": row["payload_digest"],
        "WARC-Refers-To": row["refers_to"],
        "WARC-Profile": SAME_PAYLOAD if row["record_type"] == "revisit" else None,
        "Content-Type": HTTP,
    }
    return headers, head + payload


class WarcSource(DataSource):
    """Format ``warc``: options ``path``, ``payload`` (false: headers only), ``compression``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages --------------------------------------------------------------------------------

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:x-page:"


def base32(hex_digest: Column) -> Column:
    """A SHA-1 in hex as 32 letters: five hex digits are four letters."""
    groups = [
        F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), _DIGITS, _LETTERS)


def page_records(pages: DataFrame, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z"):
    """One record per row of ``pages (page_id, url, html)``, equal payloads written once.

    Of payloads of at least ``least_bytes`` bytes that are equal, the row with the smallest
    page_id is the response (each of them, if rows repeat it), the others are revisits of it.
    Null html is an empty payload; a row without page_id is a response nothing refers to; a
    null url has no header. Other columns are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(
        "page_id",
        F.col("url").alias("target_uri"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("sha1"),
    )
    first = written(
        rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha1", "first"),
        "first",
    )
    again = (F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= least_bytes)
    again = F.coalesce(again, F.lit(False))
    name = lambda c: F.concat(F.lit("<" + _ID), F.col(c).cast("string"), F.lit(">"))
    return rows.join(broadcast_if_small(first, 200_000), "sha1", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name("page_id"), F.lit(f"<{_ID}>")).alias("record_id"),
        F.lit(date).alias("record_date"),
        "target_uri",
        F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        F.when(again, name("first")).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **options) -> None:
    spark = pages.sparkSession
    register(spark)
    bounded_batches(spark)
    page_records(pages).write.format("warc").mode("append").options(**options).save(path)


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def page_summary(records: DataFrame) -> DataFrame:
    """Per record: page, full payload's size and digest, type, and the page it refers to.

    Of a response they are taken from the payload that was read, of a revisit from its headers.
    """
    page = lambda c: F.regexp_extract(c, rf"^<{_ID}(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    whole = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias(
            "payload_bytes"
        ),
        F.when(whole, base32(F.sha1("payload")))
        .otherwise(F.substring("payload_digest", 6, 32))
        .alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    path = shared_folder(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    return page_summary(read_records(spark, path))
