"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

Archives are files of at most about ``archive_bytes`` before compression, each made by one task and read back
by one task. They are written and read by Spark's text and binary file sources, so they may lie in any store
that Spark reads. A record that is longer alone is an archive alone.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog.session import new_run_dir
from llm.batches import text_of

#: Fixed values of the formats: field lists of the two ARC versions, and what follows a WARC record.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = "\r\n\r\n"
#: Payloads shorter than this are never stored as revisits.
REVISIT_BYTES = 100

ARC_SCHEMA = (
    "archive string, offset long, url string, ip string, date string, mime string, block binary, problem string"
)
WARC_SCHEMA = (
    "record_id string, type string, uri string, date string, payload_digest string, payload_bytes long, "
    "page_id long, refers_to long, payload binary, problem string"
)


def _spaceless(value: str) -> str:
    """White space and control characters would break header lines."""
    return quote(value, safe="".join(map(chr, range(33, 127)))) or "-"


def _http_block(payload: bytes, page_id: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
    head += "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return head.encode() + b"\r\n" + payload


def write_arc(pages: DataFrame, path: str, version: str = "1", date: str = "20000101000000", archive_bytes: int = 8 << 20) -> None:
    """Write ``page_id, url, html`` as gzipped ARC files of ``version``. Null html counts as empty."""
    fields = ARC_FIELDS[version]

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        declared = f"{version} 0 converter\n{fields}\n"
        kinds = "text/plain" if version == "1" else "text/plain 200 - - 0 -"
        first = f"filedesc://pages.arc 0.0.0.0 {date} {kinds} {len(declared)}\n{declared}".encode()
        held, size = [first], len(first)
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                block = _http_block(html.encode(), page_id)
                more = "text/html" if version == "1" else "text/html 200 - - 0 -"
                record = f"{_spaceless(url)} 0.0.0.0 {date} {more} {len(block)}\n".encode() + block
                if len(held) > 1 and size + len(record) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.string())], names=["value"])
                    held, size = [first], len(first)
                held.append(record)
                size += len(record) + 1
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.string())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), text_of("html").alias("html"))
    _write_archives(rows.mapInArrow(archives, "value string"), path, "\n")


def _write_archives(archives: DataFrame, path: str, end: str) -> None:
    """A file per row. ``end`` closes the last record of an archive."""
    archives.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Offset, named header fields, block and problem of each record of an ARC file.

    The first record declares the version and the fields of the header lines that follow. A header that doesn't
    fit, or a length that runs past the end, is reported as the last record: what follows it can't be found.
    """
    names, at = ARC_FIELDS["1"].split(), 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        if at == 0 and line.startswith("filedesc:"):
            names = ARC_FIELDS["2" if len(values) == 10 else "1"].split()
        if end < 0 or len(values) != len(names) or not values[-1].isdecimal():
            yield at, {}, data[at:], "header line doesn't fit the declared fields"
            return
        fields = dict(zip(names, values))
        block = data[end + 1 : end + 1 + int(values[-1])]
        if len(block) < int(values[-1]):
            yield at, fields, block, "declared length runs past the end"
            return
        if at == 0 and line.startswith("filedesc:"):
            declared = block.decode("utf-8", "replace").split("\n")
            if len(declared) > 1 and declared[1].strip():
                names = declared[1].split()
        yield at, fields, block, None
        at = end + 1 + len(block)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files under ``path``, the version blocks too; ``problem`` is null if it is whole."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in ARC_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64()] + [pa.string()] * 4 + [pa.binary(), pa.string()]
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch.column("path")[at].as_py().rsplit("/", 1)[-1]
                rows = [
                    (name, at, f.get("URL"), f.get("IP-address"), f.get("Archive-date"), f.get("Content-type"), block, problem)
                    for at, f, block, problem in arc_records(gzip.decompress(batch.column("content")[at].as_py()))
                ]
                for start in range(0, len(rows), 200):
                    columns = zip(*rows[start : start + 200])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _read_archives(spark, path).mapInArrow(parse, ARC_SCHEMA)


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head + found, payload) if found and head.startswith(b"HTTP/") else (b"", block)


_PAGE = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def arc_to_warc_fields(arc: DataFrame) -> DataFrame:
    """The WARC fields of each whole ARC record but the version blocks: ``record_id, uri, date, ip, http, payload,
    page_id, payload_bytes, digest``. Identifiers are made of archive, offset and block, so they repeat."""
    schema = (
        "record_id string, uri string, date string, ip string, http binary, payload binary, page_id long, "
        "payload_bytes long, digest string"
    )

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in schema.split(", ")]
        types = [pa.string()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2 + [pa.string()]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                http, payload = _split_http(row["block"])
                page = _PAGE.search(http)
                d = row["date"]
                name = f"{row['archive']} {row['offset']} {hashlib.sha256(row['block']).hexdigest()}"
                rows.append(
                    (
                        f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
                        row["url"],
                        f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10] or '00'}:{d[10:12] or '00'}:{d[12:14] or '00'}Z",
                        row["ip"],
                        http,
                        payload,
                        int(page[1]) if page else None,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                    )
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return arc.where("problem IS NULL AND NOT startswith(url, 'filedesc:')").mapInArrow(convert, schema)


def mark_revisits(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``first_id, first_page``: of the record with the smallest page id (then record id) of those with an equal
    payload of at least ``least_bytes`` bytes. Both are null for that record itself and for short payloads. Null
    page ids come last."""
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("record_id").alias("id"))
    firsts = (
        records.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    later = (F.col("payload_bytes") >= least_bytes) & (F.col("first.id") != F.col("record_id"))
    return records.join(firsts, "digest", "left").select(
        *records.columns,
        F.when(later, F.col("first.id")).alias("first_id"),
        F.when(later, F.col("first.page")).alias("first_page"),
    )


def write_warc(records: DataFrame, path: str, archive_bytes: int = 8 << 20) -> None:
    """Write marked records as gzipped WARC 1.0 files: responses with payload, revisits with the HTTP head only."""

    def record(row: dict) -> bytes:
        revisit = row["first_id"] is not None
        block = row["http"] + (b"" if revisit else row["payload"])
        lines = [
            "WARC/1.0",
            f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {row['record_id']}",
            f"WARC-Target-URI: {row['uri']}",
            f"WARC-Date: {row['date']}",
            f"WARC-IP-Address: {row['ip']}",
            f"WARC-Payload-Digest: sha256:{row['digest']}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}",
        ]
        if revisit:
            lines += [
                "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                f"WARC-Refers-To: {row['first_id']}",
                f"X-Refers-To-Page-Id: {'' if row['first_page'] is None else row['first_page']}",
            ]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = RECORD_END.encode()
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                found = record(row)
                if held and size + len(found) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.string())], names=["value"])
                    held, size = [], 0
                held.append(found)
                size += len(found) + len(end)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.string())], names=["value"])

    _write_archives(records.mapInArrow(archives, "value string"), path, RECORD_END)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Named fields, block and problem of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        length = fields.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not length.isdecimal():
            yield fields, data[at:], "no record header"
            return
        block = data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)
        yield fields, block, None if data[at : at + 4] == RECORD_END.encode() else "declared length doesn't end at a record's end"
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``. A response's digest and length are those of the payload
    that is there, a revisit's those that it declares; ``problem`` is set where a declared digest is wrong."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in WARC_SCHEMA.split(", ")]
        types = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.binary(), pa.string()]

        def row(f: dict[str, str], block: bytes, problem: str | None) -> tuple:
            http, payload = _split_http(block)
            page, length = _PAGE.search(http), _LENGTH.search(http)
            declared = f.get("warc-payload-digest", "").removeprefix("sha256:")
            digest, size, refers = hashlib.sha256(payload).hexdigest(), len(payload), None
            if f.get("warc-type") == "revisit":
                digest, size = declared, int(length[1]) if length else None
                refers = int(f["x-refers-to-page-id"]) if f.get("x-refers-to-page-id") else None
            elif declared and declared != digest:
                problem = problem or "payload doesn't have the declared digest"
            return (
                f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), digest, size,
                int(page[1]) if page else None, refers, payload, problem,
            )

        for batch in batches:
            for at in range(batch.num_rows):
                rows = [row(*found) for found in warc_records(gzip.decompress(batch.column("content")[at].as_py()))]
                for start in range(0, len(rows), 200):
                    columns = zip(*rows[start : start + 200])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _read_archives(spark, path).mapInArrow(parse, WARC_SCHEMA)


def convert_pages(pages: DataFrame, version: str = "1", archive_bytes: int = 8 << 20) -> DataFrame:
    """Write pages as ARC files, convert these to WARC files, and read those back.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and ``record_id,
    problem``. Null html is an empty payload. Repeated rows give a record each, of which one is the response. A
    null page id stays null and is never a ``refers_to`` if another id has the payload. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc, out = new_run_dir(spark, "arc"), new_run_dir(spark, "warc")
    write_arc(pages, arc, version, archive_bytes=archive_bytes)
    write_warc(mark_revisits(arc_to_warc_fields(read_arc(spark, arc))), out, archive_bytes)
    return read_warc(spark, out).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "record_id", "problem"
    )
