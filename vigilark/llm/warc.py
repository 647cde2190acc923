"""Legacy web archives (ARC) converted to WARC.

An ARC file starts with a version block whose lines name its version and the fields of the record lines that follow;
each record is one such line and as many bytes as the line declares. Version 1 lines hold address, IP, date, type and
length; version 2 lines hold status, checksum, location, offset and file name as well.

`convert` parses every archive by its own field line and the declared lengths, and writes WARC/1.1 records whose
identifier, timestamp, type and digests are made from what the ARC record holds: the identifier from the archive's
name and the record's place, the timestamp from the 4 to 14 digits of its date (missing ones are the earliest), the
type from the content, SHA-1 digests of block and payload. Of records with equal payloads the one with the largest
page id (then record id) is the response; the others become revisits, which keep their HTTP head and point to it.

Archives are written by Spark's text sink, one row and so one file per archive, compressed as one gzip stream, and
read by its binary source: any storage Spark reaches will do. An archive is closed before it passes ARCHIVE_BYTES; a
larger page has an archive of its own. Only identifiers and digests are shuffled to find equal payloads; payloads are
shuffled only when the revisits are too many to be broadcast.

Cases: null html is an empty payload; a null or blank url is written as `-`, white space and controls in it are
escaped; null page ids stay null and are the smallest; rows that share a page id are records of their own; an archive
that ends inside a record gives that record its remaining bytes, marked truncated; lines that are no record line are
passed over; an empty table gives archives without records and an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.llm.common import stored
from vigilark.llm.decontaminate import if_small

ARCHIVE_BYTES = 16 << 20
PAGE_ID = b"X-Page-Id"  # HTTP header that carries the page id through the archives
# fixed values: field lines of the two ARC versions, and the WARC profile of records that repeat a payload
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[bytes, bytes]
    content: bytes
    truncated: bool


# ---- bytes ---------------------------------------------------------------------------------------


def escaped(address: str | None) -> bytes:
    """An address without white space or control characters."""
    raw = (address or "").strip().encode("utf-8", "surrogateescape")
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], raw) or b"-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    named = b"" if page_id is None else b"%s: %d\r\n" % (PAGE_ID, page_id)
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + named
            + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)


def arc_start(name: bytes, version: int, date: bytes) -> bytes:
    body = b"%d 0 vigilark\n%s\n\n" % (version, FIELDS[version])
    extra = b"" if version == 1 else b" 200 - - 0 " + name
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s" % (name, date, extra, len(body), body)


def arc_record(version: int, address: bytes, date: bytes, content: bytes, offset: int, name: bytes) -> bytes:
    """A record and the line end after it."""
    extra = b"" if version == 1 else b" 200 %s - %d %s" % (hashlib.md5(content).hexdigest().encode(), offset, name)
    return b"%s 0.0.0.0 %s text/html%s %d\n%s\n" % (address, date, extra, len(content), content)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """Records of an archive, its version block left out."""
    names, at = FIELDS[1].split(), 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        offset, line, at = at, data[at:end].rstrip(b"\r"), end + 1
        is_start = line.startswith(b"filedesc://")
        parts = line.rsplit(b" ", 1) if is_start else line.rsplit(b" ", len(names) - 1)
        if not (is_start or len(parts) == len(names)) or not parts[-1].isdigit():
            continue
        size = int(parts[-1])
        content, at = data[at:at + size], min(at + size, len(data))
        if is_start:  # the block names the fields of the lines that follow
            lines = content.split(b"\n")
            version = lines[0].split(b" ")[0]
            named = lines[1].split() if len(lines) > 1 else []
            names = named if named[-1:] == [b"Archive-length"] else FIELDS[2 if version == b"2" else 1].split()
            continue
        yield ArcRecord(offset, dict(zip(names, parts)), content, len(content) < size)


def head_and_payload(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP block cut after its head; a block that is none has no head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    cut = min(ends, default=len(block))
    return block[:cut], block[cut:]


def header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^%s:[ \t]*(.*?)[ \t]*\r?$" % re.escape(name), head)
    return found.group(1) if found else None


def whole_number(value: bytes | None) -> int | None:
    if not value or not re.fullmatch(rb"-?[0-9]{1,19}", value):
        return None
    return int(value) if -(1 << 63) <= int(value) < 1 << 63 else None


def timestamp(digits: bytes) -> str:
    """A WARC date from 4 to 14 digits; others are the first instant of 1970."""
    text = digits.decode("latin-1")
    if not re.fullmatch(r"[0-9]{4,14}", text):
        text = "1970"
    text += "00000101000000"[len(text):] if len(text) >= 4 else ""
    parts = text[:4], text[4:6], text[6:8], text[8:10], text[10:12], text[12:14]
    month, day = max(parts[1], "01"), max(parts[2], "01")
    return f"{parts[0]}-{month}-{day}T{parts[3]}:{parts[4]}:{parts[5]}Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str, record: ArcRecord) -> str:
    place = b"\n".join([name.encode(), b"%d" % record.offset, *record.fields.values()])
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(place).digest()[:16], version=5)}"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def warc_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header lines, block) of each record, by the declared lengths."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = data[at:end + 2]
        size = whole_number(header(head, b"Content-Length")) or 0
        yield head, data[end + 4:end + 4 + size]
        at = data.find(b"WARC/", end + 4 + size)


def unpacked(content: bytes) -> bytes:
    """The archive's bytes: one or more gzip streams, or plain."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out = []
    while content.startswith(b"\x1f\x8b"):
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(content))
        content = stream.unused_data
    return b"".join(out)


# ---- archives ------------------------------------------------------------------------------------


def _packed(start: Callable[[bytes, int], bytes], entries: Callable, most: int):
    """One row per archive: `entries` makes a record from (row, archive's name, its number, place in it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        name = b"%08d-%05d" % (part, number)
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if held and size + sum(len(v) for v in row.values() if isinstance(v, bytes)) > most:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})
                    number, held, size = number + 1, [], 0
                    name = b"%08d-%05d" % (part, number)
                if not held:
                    held.append(start(name, number))
                    size = len(held[0])
                held.append(entries(row, name, number, size))
                size += len(held[-1])
        if held:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(held)], pa.binary())})

    return run


def _write(archives: DataFrame, path: str, line_end: str) -> None:
    (archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", line_end).option("compression", "gzip").text(path))


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", most: int = ARCHIVE_BYTES) -> None:
    """ARC archives of pages (page_id, url, html), versions 1 and 2 in turn."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    day = date.encode()

    def entry(row: dict, name: bytes, number: int, size: int) -> bytes:
        block = http_block(row["page_id"], row["payload"])
        return arc_record(1 + number % 2, escaped(row["url"]), day, block, size, name)

    packed = _packed(lambda name, number: arc_start(name, 1 + number % 2, day), entry, most)
    _write(rows.mapInArrow(packed, "archive binary"), path, "\n")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """name, content of every archive below `path`; none when there are no files."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content")


_KEYS = "record_id string, page_id long, uri string, warc_date string, payload_key binary"
_WHOLE = "record_id string, page_id long, uri string, warc_date string, ip string, mime string, truncated boolean, block binary"


def _as_table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _parsed(schema: str, row_of: Callable, rows_of: Callable, most: int = 4 << 20):
    """Rows of the records of archives, a few megabytes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                held, size = [], 0
                for record in rows_of(unpacked(batch.column("content")[at].as_py())):
                    held.append(row_of(batch.column("name")[at].as_py(), record))
                    size += 200 + sum(len(v) for v in held[-1] if isinstance(v, bytes))
                    if size > most:
                        yield _as_table(schema, held)
                        held, size = [], 0
                if held:
                    yield _as_table(schema, held)

    return run


def _text(value: bytes | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", (value or b"-").decode("utf-8", "replace"))


def _key_row(name: str, record: ArcRecord) -> tuple:
    head, payload = head_and_payload(record.content)
    return (record_id(name, record), whole_number(header(head, PAGE_ID)), _text(record.fields.get(b"URL")),
            timestamp(record.fields.get(b"Archive-date", b"")), hashlib.sha256(payload).digest())


def _whole_row(name: str, record: ArcRecord) -> tuple:
    head, _ = head_and_payload(record.content)
    return (record_id(name, record), whole_number(header(head, PAGE_ID)), _text(record.fields.get(b"URL")),
            timestamp(record.fields.get(b"Archive-date", b"")), _text(record.fields.get(b"IP-address")),
            _text(record.fields.get(b"Content-type")), record.truncated, record.content)


def _warc_entry(row: dict, *_) -> bytes:
    head, payload = head_and_payload(row["block"])
    again = row["to_id"] is not None
    block = head if again else row["block"]
    kind = "revisit" if again else "response" if head else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["warc_date"]),
              ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]),
              ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    if again:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['to_id']}>"),
                   ("WARC-Refers-To-Target-URI", row["to_uri"]), ("WARC-Refers-To-Date", row["to_date"])]
    if row["truncated"] or again:
        fields.append(("WARC-Truncated", "length"))
    fields.append(("Content-Type", "application/http; msgtype=response" if head else row["mime"]))
    return warc_record(fields, block) + b"\r\n\r\n"


def _warc_start(name: bytes, _: int) -> bytes:
    label = name.decode()
    block = b"software: vigilark\r\nformat: WARC File Format 1.1\r\n"
    made = f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(b'warcinfo ' + name).digest()[:16], version=5)}"
    return warc_record([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{made}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Filename", label), ("Content-Type", "application/warc-fields")], block) + b"\r\n\r\n"


def repeated_payloads(keys: DataFrame) -> DataFrame:
    """record_id, to_id, to_uri, to_date of records whose payload another record stands for.

    `keys` is a stored table of record_id, page_id, uri, warc_date, payload_key; a common payload is reduced before
    it is shuffled.
    """
    first = F.max(F.struct("page_id", "record_id", "uri", "warc_date")).alias("to")
    classes = stored(
        keys.groupBy("payload_key").agg(F.count("*").alias("n"), first).filter("n > 1")
        .select(F.col("payload_key").alias("_key"), "to"), "warc-classes")
    return keys.join(if_small(classes), F.col("payload_key") == F.col("_key")).filter("record_id <> to.record_id").select(
        "record_id", F.col("to.record_id").alias("to_id"), F.col("to.uri").alias("to_uri"), F.col("to.warc_date").alias("to_date"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, most: int = ARCHIVE_BYTES) -> None:
    """WARC archives at `warc_path` of the ARC archives at `arc_path`."""
    source = archives(spark, arc_path)
    keys = stored(source.mapInArrow(_parsed(_KEYS, _key_row, arc_records), _KEYS), "warc-keys")
    again = stored(repeated_payloads(keys).withColumnRenamed("record_id", "_id"), "warc-revisits")
    whole = source.mapInArrow(_parsed(_WHOLE, _whole_row, arc_records), _WHOLE)
    typed = whole.join(if_small(again), F.col("record_id") == F.col("_id"), "left").drop("_id", "page_id")
    _write(typed.mapInArrow(_packed(_warc_start, _warc_entry, most), "archive binary"), warc_path, "\r\n")


_READ = ("record_id string, record_type string, uri string, warc_date string, page_id long, refers_to_id string, "
         "payload_bytes long, payload_digest string, digest_holds boolean, truncated boolean")


def _read_row(with_payload: bool):
    def named(head: bytes, name: bytes) -> str | None:
        value = header(head, name)
        return None if value is None else value.decode("utf-8", "replace").removeprefix("<").removesuffix(">")

    def run(_: str, record: tuple[bytes, bytes]) -> tuple:
        head, block = record
        http, payload = head_and_payload(block)
        kind, digest = named(head, b"WARC-Type"), (named(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:") or None
        again = kind == "revisit"
        checked = named(head, b"WARC-Block-Digest") == f"sha1:{sha1(block)}" and (again or digest == sha1(payload))
        row = (named(head, b"WARC-Record-ID"), kind, named(head, b"WARC-Target-URI"), named(head, b"WARC-Date"),
               whole_number(header(http, PAGE_ID)), named(head, b"WARC-Refers-To"),
               whole_number(header(http, b"Content-Length")) if again else len(payload), digest, checked,
               header(head, b"WARC-Truncated") is not None)
        return (*row, None if again else payload) if with_payload else row

    return run


def _content_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    return (r for r in warc_records(data) if header(r[0], b"WARC-Type") != b"warcinfo")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record other than warcinfo; `payload` too if wanted (null for revisits).

    payload_bytes is the full payload's: of a revisit the length that its HTTP head declares. digest_holds tells
    whether the digests are those of the bytes read.
    """
    schema = _READ + ", payload binary" * with_payload
    return archives(spark, path).mapInArrow(_parsed(schema, _read_row(with_payload), _content_records), schema)


def with_referred_page(records: DataFrame) -> DataFrame:
    """records, a stored table, with refers_to: the page id of the record that refers_to_id names."""
    wanted = records.filter("refers_to_id is not null").select("refers_to_id").distinct()
    pages = stored(
        records.select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"))
        .join(wanted, F.col("_id") == F.col("refers_to_id"), "left_semi"), "warc-referred")
    return records.join(if_small(pages), F.col("refers_to_id") == F.col("_id"), "left").drop("_id")
