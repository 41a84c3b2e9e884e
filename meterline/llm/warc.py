"""WARC derivatives: from responses, linked metadata and plain-text conversion records (operator 3).

A record is a row: its header fields in columns, its block as text. A derived record refers to its response's
identifier, keeps the response's target, date, digests and HTTP headers, and has an identifier of its own that follows
from them, so that reruns agree. Each response is derived where it is, without a shuffle.

Files: a gzip member a record, so that a record can be read by its place alone (`index`). Spark's text sink writes the
members as they are; its line separator is an empty member, which holds nothing for any reader of gzip. Spark's text
source cuts such files at it, so one file is read by many tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, small_batches
from .dom import Page, attributes, joined, parse

#: Pages don't say when they were fetched; their responses bear this date.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: An empty gzip member: header without name and time, an empty block, checksum and length of nothing.
EMPTY = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
#: What stands between the records of files by others, which Spark decompresses.
BETWEEN = f"{END}WARC/".encode()
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
# Header fields of a WARC record, and the columns that hold them. The source's digest is a field of our own:
# that of the payload is the record's own.
FIELDS = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "WARC-Refers-To": "refers_to",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "warc_date",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Block-Digest": "block_digest",
    "WARC-Source-Payload-Digest": "source_digest",
    "Content-Type": "content_type",
    "Content-Length": "content_length",
}
LOWER = {field.lower(): column for field, column in FIELDS.items()}
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, source_digest string, content_length long, block string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in RECORD.split(", ")])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps(parts))}>"


def one_line(value: str | None) -> str | None:
    """A header value can't hold line ends."""
    return " ".join(value.split()) if value is not None else None


def record(page_id: int | None, kind: str, refers: str | None, uri: str | None, date: str, content: str, payload: str, source: str | None, block: str, own_id: str) -> tuple:
    data = block.encode()
    return (page_id, kind, own_id, refers, one_line(uri), date, content, payload, digest(data), source, len(data), block)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)


def responses(pages: DataFrame) -> DataFrame:
    """A response record of each row of pages: HTTP headers, a blank line and the html; null html is an empty payload."""
    small_batches(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            payload = (html or "").encode()
            sum_ = digest(payload)
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n{html or ''}"
            rows.append(record(page_id, "response", None, url, DATE, "application/http; msgtype=response", sum_, None, block, identifier("response", str(page_id), url, sum_)))
        return to_batch(rows)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, RECORD)


def split_http(block: str) -> tuple[str, dict[str, str], str]:
    """(status line, headers, payload) of an HTTP response. A block without a blank line has no payload."""
    head, _, payload = block.partition("\r\n\r\n")
    status, *lines = head.split("\r\n")
    headers: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        if name.strip():
            headers[name.strip()] = ", ".join(x for x in (headers.get(name.strip()), value.strip()) if x)
    return status, headers, payload


def outlinks(page: Page, base: str | None) -> list[dict[str, str]]:
    found = []
    for tag, raw in zip(page.tag, page.attributes):
        if tag in ("a", "img", "link", "iframe", "area") and raw:
            own = attributes(raw)
            target = own.get("href") or own.get("src")
            if target:
                try:
                    found.append({"element": tag, "url": urljoin(base or "", target)})
                except ValueError:
                    found.append({"element": tag, "url": target})
    return found


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record of each response among the records; other records have none.

    Metadata is a JSON block: the response's identifier, digests, HTTP status and headers, the page's title and links.
    Conversion is the page's text, blocks two line feeds apart. Both refer to the response and keep its target, date
    and, as source_digest, payload digest. A null block counts as empty. Records that repeat are derived each, with equal identifiers. An
    empty table gives none; other columns aren't read.
    """
    small_batches(records.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.to_pylist():
            status, headers, payload = split_http(x["block"] or "")
            page, date = parse(payload), x["warc_date"] or DATE
            text = joined(page, [i for i, tag in enumerate(page.tag) if not tag])
            sum_ = x["payload_digest"] or digest(payload.encode())
            block = json.dumps(
                {
                    "refers-to": x["record_id"],
                    "source-block-digest": x["block_digest"],
                    "source-payload-digest": sum_,
                    "http-status": status,
                    "http-headers": headers,
                    "title": page.title,
                    "links": outlinks(page, x["target_uri"]),
                    "text-digest": digest(text.encode()),
                },
                ensure_ascii=False,
            )
            for kind, content, own in (("metadata", "application/json", block), ("conversion", "text/plain; charset=utf-8", text)):
                rows.append(record(x["page_id"], kind, x["record_id"], x["target_uri"], date, content, digest(own.encode()), sum_, own, identifier(kind, x["record_id"], sum_)))
        return to_batch(rows)

    return map_arrow(records.where("record_type = 'response'").select(*NAMES), run, RECORD)


def serialized(records: DataFrame) -> Column:
    """A record as text without the blank lines at its end; absent fields are left out."""
    lines = [F.concat(F.lit(f"{field}: "), F.col(column).cast("string")) for field, column in FIELDS.items()]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), F.coalesce("block", F.lit("")))


def write(records: DataFrame, path: str) -> None:
    """WARC files under path, one for each partition, a gzip member a record, by Spark's text sink. No records: no files."""

    def members(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [gzip.compress((x + END).encode(), mtime=0) for x in batch.column("value").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])

    small_batches(records.sparkSession)
    packed = map_arrow(records.select(serialized(records).alias("value")), members, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.options(**pieces(EMPTY)).text(path)


def pieces(between: bytes) -> dict[str, str]:
    """Options of Spark's text source and sink by which any bytes stand between lines."""
    return {"lineSep": between.decode("latin-1"), "encoding": "ISO-8859-1"}


def raw(spark: SparkSession, path: str, between: bytes) -> DataFrame:
    """(value, file, start): the bytes between separators, with file and first byte of the split that has them."""
    rows = spark.read.options(**pieces(between)).text(path)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under path, in columns; page_id isn't in the files and is null.

    Files of `write` are cut at records and read by as many tasks as they have splits. Other files whose names end in
    .gz are decompressed by Spark and read record by record, a file a task; they may have a member a record or one for
    all. Other files without compression, or with another name, are one value of 2 GB at most. A record that its file
    ends in the middle of has the block that is there, and one without a length ends where the next begins. Bytes that
    aren't UTF-8 are replaced. Files without records, and empty ones, give no rows.
    """
    small_batches(spark)
    compressed = F.col("file").endswith(".gz")

    def parsed(batch: pa.RecordBatch) -> pa.Table | None:
        rows = [r for data in batch.column("value").to_pylist() for r in split_records(unpacked(data))]
        return pa.Table.from_batches([to_batch(rows)]) if rows else None

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lacks, of = [b""], 0, None
        for batch in batches:
            rows: list[tuple] = []
            for data, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist()):
                if of == file and lacks > 0:  # what looks like another record's start is in the block
                    held.append(BETWEEN + data)
                    lacks -= len(held[-1])
                else:
                    rows += split_records(b"".join(held))
                    held, lacks, of = [(b"WARC/" if of == file else b"") + data], 0, file
                if lacks <= 0:
                    held = [b"".join(held)]
                    lacks = missing(held[0])
            if rows:
                yield to_batch(rows)
        if rows := list(split_records(b"".join(held))):
            yield to_batch(rows)

    own = map_arrow(raw(spark, path, EMPTY).where(~compressed).select("value"), parsed, RECORD)
    return own.unionByName(raw(spark, path, BETWEEN).where(compressed).select("value", "file").mapInArrow(streamed, RECORD))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, length, record_id, record_type, target_uri) of each record of files of `write`.

    The member at this place of the file, of this length, is the record. Places are sums of lengths in a file's order,
    a window a file, over rows without blocks.
    """

    def heads(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("value").to_pylist()
        found = [next(split_records(unpacked(x)), (None,) * len(NAMES)) for x in data]
        named = [pa.array([r[NAMES.index(c)] for r in found], pa.string()) for c in ("record_id", "record_type", "target_uri")]
        kept = [batch.column(c) for c in ("file", "start", "number")]
        return pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in data], pa.int64()), *named], ["file", "start", "number", "length", "record_id", "record_type", "target_uri"])

    small_batches(spark)
    rows = raw(spark, path, EMPTY).withColumn("number", F.monotonically_increasing_id())
    rows = map_arrow(rows, heads, "file string, start long, number long, length long, record_id string, record_type string, target_uri string")
    before = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(F.col("length") + len(EMPTY)).over(before), F.lit(0))
    return rows.select("file", place.alias("place"), "length", "record_id", "record_type", "target_uri")


def unpacked(data: bytes) -> bytes:
    """data, or what its gzip members hold; members that are cut off give what they can."""
    if data[:2] != b"\x1f\x8b":
        return data
    members = []
    while data[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        members.append(unzip.decompress(data) + unzip.flush())
        data = unzip.unused_data
    return b"".join(members)


def head_of(data: bytes, start: int) -> tuple[dict[str, str], int, int] | None:
    """(fields, first byte of the block, its length or -1) of the record whose version is at start; None without an end of its head."""
    end = data.find(END.encode(), start)
    if end < 0:
        return None
    lines = re.sub("\r\n[ \t]+", " ", data[start:end].decode("utf-8", "replace")).split("\r\n")[1:]
    fields = {LOWER.get(name.strip().lower(), name): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    length = fields.get("content_length", "")
    return fields, end + len(END), int(length) if length.isdecimal() else -1


def missing(data: bytes) -> int:
    """Bytes that the last record in data lacks at least; 0 if none does."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        found = head_of(data, start)
        if found is None:
            return 1
        at = found[1] + max(found[2], 0)
        if at > len(data):
            return at - len(data)
        if found[2] < 0:
            return 0
    return 0


def split_records(data: bytes) -> Iterator[tuple]:
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        found = head_of(data, start)
        if found is None:
            return
        fields, first, length = found
        if length < 0:
            after = data.find(BETWEEN, first)
            length = (after if after >= 0 else len(data)) - first
        block = data[first : first + length].decode("utf-8", "replace")
        yield (None, *(fields.get(c) for c in NAMES[1:-2]), length, block)
        at = first + length
