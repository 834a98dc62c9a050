"""Legacy web archives (ARC) to WARC, and WARC files written and read back.

An ARC is a version block, whose body names the version (1 or 2) of all header lines after it, and
records: one header line, as many bytes as its last field declares, a line break. The converter
follows the declared lengths, reads the header line by its version, takes the HTTP headers off the
payload, and makes up what WARC wants: a record id, a W3C date, the record type, and SHA-1 digests
in base 32. Of records with equal payloads one stays a response and the others become revisits.

Files are written by Spark's own text writer, whose line separator is the end of a record, so they
can go wherever Spark can write, and a lost task leaves nothing behind. Each row written is a run
of records of about ``CHUNK_BYTES``, and a file has ``CHUNKS_PER_FILE`` rows, so reading a file back
takes bounded memory unless a single payload is itself that large.

Null payloads count as empty. A null URL is written as ``-`` and read back as null. Rows with a null
key are archived like others and rank below all keys. An empty table gives no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir

CHUNK_BYTES = 4 << 20
CHUNKS_PER_FILE = 8

#: The header lines of the two ARC versions.
ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = "X-Archive-Key"

RECORD_SCHEMA = (
    "url string, ip string, warc_date string, record_id string, arc_version int, record_key bigint,"
    " http_head binary, payload binary, payload_bytes bigint, payload_digest string"
)
_RECORD = pa.schema(
    [
        ("url", pa.string()),
        ("ip", pa.string()),
        ("warc_date", pa.string()),
        ("record_id", pa.string()),
        ("arc_version", pa.int32()),
        ("record_key", pa.int64()),
        ("http_head", pa.binary()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _chunks(records: Iterable[bytes], between: bytes, head: bytes | None) -> Iterator[bytes]:
    """Records joined to runs of about ``CHUNK_BYTES``; the first run of each file begins with ``head``."""
    run: list[bytes] = []
    size = made = 0
    for record in records:
        if run and size + len(record) > CHUNK_BYTES:
            yield between.join(run)
            made, run, size = made + 1, [], 0
        if not run and head is not None and made % CHUNKS_PER_FILE == 0:
            run.append(head)
        run.append(record)
        size += len(record) + len(between)
    if run:
        yield between.join(run)


def _rows(chunks: Iterable[bytes], name: str) -> Iterator[pa.RecordBatch]:
    for chunk in chunks:
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.large_binary())], [name])


# --- ARC ---------------------------------------------------------------------


def version_block(version: int, date: str = "19700101000000") -> bytes:
    body = f"{version} 0 legacy\n{ARC_TITLES[version]}\n".encode()
    rest = {1: "text/plain", 2: "text/plain 200 - - 0 legacy.arc"}[version]
    return b"filedesc://legacy.arc 0.0.0.0 %s %s %d\n%s" % (date.encode(), rest.encode(), len(body), body)


def arc_record(version: int, url: str | None, key: int | None, payload: bytes, date: str = "20000101000000") -> bytes:
    """One record: an HTTP response with ``payload``, in the header line of ``version``."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if key is not None:
        head += f"{KEY_HEADER}: {key}\r\n".encode()
    body = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    rest = "text/html" if version == 1 else f"text/html 200 {digest(payload)} - 0 legacy.arc"
    return f"{target} 0.0.0.0 {date} {rest} {len(body)}\n".encode() + body


def to_arc(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """ARC archives of the rows, one per row ``arc`` (binary): version 1 and version 2 in turn."""

    def run(batches):
        def archives():
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(3)]
                for k, u, body in zip(*columns, strict=True):
                    yield k, u, (body or "").encode()

        made = 0
        records: list[bytes] = []
        size = 0
        for k, u, body in archives():
            version = 1 + made % 2
            records.append(arc_record(version, u, k, body))
            size += len(body)
            if size >= CHUNK_BYTES:
                yield from _rows([b"\n".join([version_block(version), *records]) + b"\n"], "arc")
                made, records, size = made + 1, [], 0
        if records:
            yield from _rows([b"\n".join([version_block(1 + made % 2), *records]) + b"\n"], "arc")

    return pages.select(key, url, payload).mapInArrow(run, "arc binary")


def parse_arc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(version, offset, header fields, body) of every record after the version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC record at byte {at}: no header line")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = line.rpartition(" ")[2]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"ARC record at byte {at}: declared length {length!r} does not fit")
        body = data[end + 1 : end + 1 + int(length)]
        if line.startswith("filedesc:"):
            version = int(body.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        else:
            if not version:
                raise ValueError("ARC without a version block")
            names = ARC_FIELDS[version]
            # A URL may hold blanks; no other field does, so fields are counted from the right.
            fields = line.rsplit(" ", len(names) - 1)
            if len(fields) != len(names):
                raise ValueError(f"ARC record at byte {at}: {len(fields)} fields, version {version} has {len(names)}")
            yield version, at, dict(zip(names, fields, strict=True)), body
        at = end + 1 + int(length)


def warc_date(date: str) -> str:
    """14, 12 or 8 digits to W3C form; anything else becomes the epoch."""
    digits = date if re.fullmatch(r"\d{14}|\d{12}|\d{8}", date) else "19700101"
    try:
        when = datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S")
    except ValueError:
        when = datetime(1970, 1, 1)
    return when.replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP headers, with the blank line, and payload; a body that is no HTTP message is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    return (body[: found.end()], body[found.end() :]) if found else (body, b"")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def archive_key(head: bytes) -> int | None:
    """The key in HTTP headers; what is no integer of 64 bits is no key."""
    text = http_field(head, KEY_HEADER)
    if not text or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return key if -(1 << 63) <= (key := int(text)) < 1 << 63 else None


def convert(archives: DataFrame, arc: str = "arc") -> DataFrame:
    """ARC archives (one per row, gzipped or not) to record parts in the columns of ``RECORD_SCHEMA``."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch.column(0):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                # Two archives may hold the same bytes, so their place counts too.
                number += 1
                source = f"{hashlib.sha1(data).hexdigest()} {task} {number}"
                rows, size = [], 0
                for version, offset, fields, body in parse_arc(data):
                    head, payload = split_http(body)
                    rows.append(
                        {
                            "url": None if fields["url"] == "-" else fields["url"],
                            "ip": fields["ip"],
                            "warc_date": warc_date(fields["date"]),
                            "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{source} {offset} {fields['url']}")),
                            "arc_version": version,
                            "record_key": archive_key(head),
                            "http_head": head,
                            "payload": payload,
                            "payload_bytes": len(payload),
                            "payload_digest": digest(payload),
                        }
                    )
                    size += len(body)
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return archives.select(arc).mapInArrow(run, RECORD_SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC files, one row ``arc`` each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("content").alias("arc"))


def _stored(records: DataFrame) -> DataFrame:
    """Written once to the shared folder and read from there."""
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/records-{uuid.uuid4().hex}"
    records.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(records.schema).parquet(path)


def mark_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and, for revisits, ``refers_to`` (the response's key) and ``refers_to_id``.

    Of records with equal payloads of at least ``least_bytes``, the one with the largest key (then
    the largest record id) is the response. Copies are counted before anything is joined, and only
    payloads that occur twice are looked up.

    The records are stored first: their ids depend on how rows were packed into archives, which may
    differ if they are made again, and all copies must name the same one.
    """
    records = _stored(records)
    rank = F.struct("record_key", "record_id")
    best = (
        records.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.max(rank).alias("_best"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    marked = records.join(best, records["payload_digest"] == best["_digest"], "left")
    revisit = F.coalesce(F.col("_best.record_id") != F.col("record_id"), F.lit(False))
    return marked.select(
        *records.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_best.record_key")).alias("refers_to"),
        F.when(revisit, F.col("_best.record_id")).alias("refers_to_id"),
    )


# --- WARC --------------------------------------------------------------------

#: The WARC version and the profile of revisits found by payload digest.
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def warc_record(row: dict) -> bytes:
    """One record without the two line breaks that end it. A revisit keeps the HTTP headers only."""
    revisit = row["record_type"] == "revisit"
    block = row["http_head"] if revisit else row["http_head"] + row["payload"]
    lines = [
        WARC_VERSION,
        b"WARC-Type: " + row["record_type"].encode(),
        b"WARC-Record-ID: <urn:uuid:" + row["record_id"].encode() + b">",
        b"WARC-Date: " + row["warc_date"].encode(),
        b"WARC-IP-Address: " + (row["ip"] or "0.0.0.0").encode(),
        b"WARC-Target-URI: " + (row["url"] or "-").encode(),
        b"WARC-Payload-Digest: sha1:" + row["payload_digest"].encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        lines.insert(2, b"WARC-Profile: " + REVISIT_PROFILE)
        lines.insert(3, b"WARC-Refers-To: <urn:uuid:" + row["refers_to_id"].encode() + b">")
        if row["refers_to"] is not None:
            lines.insert(4, b"X-Refers-To-Key: %d" % row["refers_to"])
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def warcinfo() -> bytes:
    block = b"software: redactlake\r\nformat: WARC File Format 1.1\r\n"
    lines = [
        WARC_VERSION,
        b"WARC-Type: warcinfo",
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, "warcinfo")).encode() + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"Content-Type: application/warc-fields",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write marked records as WARC files; each begins with a ``warcinfo`` record."""

    def run(batches):
        def made():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from map(warc_record, batch.slice(at, 64).to_pylist())

        yield from _rows(_chunks(made(), b"\r\n\r\n", warcinfo()), "value")

    rows = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    (
        rows.write.option("lineSep", "\r\n\r\n")
        .option("compression", compression)
        .option("maxRecordsPerFile", CHUNKS_PER_FILE)
        .text(path)
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared length; names in lower case."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"WARC record at byte {at}: no header")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        if end + 4 + length > len(data):
            raise ValueError(f"WARC record at byte {at}: declared length {length} does not fit")
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


WARC_SCHEMA = (
    "record_type string, record_id string, warc_date string, url string, record_key bigint, payload binary,"
    " payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_id string"
)
_WARC = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("warc_date", pa.string()),
        ("url", pa.string()),
        ("record_key", pa.int64()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("refers_to_id", pa.string()),
    ]
)


def _warc_row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    head, payload = split_http(block)
    revisit = fields["warc-type"] == "revisit"
    refers = fields.get("x-refers-to-key")
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest(payload) != named:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return {
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"][10:-1],
        "warc_date": fields["warc-date"],
        "url": None if fields["warc-target-uri"] == "-" else fields["warc-target-uri"],
        "record_key": archive_key(head),
        "payload": payload if with_payload and not revisit else None,
        "payload_bytes": int(http_field(head, "Content-Length") or 0) if revisit else len(payload),
        "payload_digest": named,
        "refers_to": int(refers) if refers else None,
        "refers_to_id": fields["warc-refers-to"][10:-1] if revisit else None,
    }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of WARC files, but for ``warcinfo``; digests are verified. A revisit has no payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                data = value.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows, size = [], 0
                for fields, block in parse_warc(data):
                    if fields["warc-type"] != "warcinfo":
                        rows.append(_warc_row(fields, block, with_payload))
                        size += len(block)
                    if size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _WARC)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _WARC)

    return files.mapInArrow(run, WARC_SCHEMA)


