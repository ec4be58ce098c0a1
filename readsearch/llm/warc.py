"""Legacy archives: ARC records parsed by version and rewritten as WARC.

An ARC file starts with a record that names the version of its header lines;
version 1 lines have five fields, version 2 lines ten, and the last field
declares the length of what follows.  Each record becomes a WARC record with an
identifier derived from its content, an ISO timestamp, a type and digests.
Archives are written and read through Spark's own file access, so they can lie
in any store: a task bundles records up to ``FILE_BYTES``, a bundle is one line
of a text file whose line separator is the two line ends that close a record,
and a file holds one bundle.  Payloads are bytes and are written as they are.
Reading goes by declared lengths alone.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, new_path, pieces, removed, slots, stored, table

#: Fields of the header lines of either version (fixed by the format).
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
#: Bytes of an archive file, unless a single record has more.
FILE_BYTES = 32 << 20
EPOCH = "20000101000000"


class ArchiveError(ValueError):
    """A header line or a declared length that does not fit the bytes."""


@dataclass
class ArcRecord:
    header: dict[str, str]
    block: bytes


def arc_file_header(version: int, name: str = "archive.arc", date: str = EPOCH) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 readsearch\n{names[version]}\n\n".encode()
    more = {1: "", 2: "200 - - 0 " + name + " "}
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more[version]}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, content_type: str, block: bytes, name: str = "archive.arc", result: int = 200) -> bytes:
    """A record as an ARC file of the version holds it; blanks in a URL are escaped, as the line is split at blanks."""
    safe = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    mid = {1: "", 2: f"{result} - - 0 {name} "}
    return f"{safe} 0.0.0.0 {date} {content_type} {mid[version]}{len(block)}\n".encode() + block


def read_arc(data: bytes | io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC file after the one that describes it.  Of a stream
    no more than a record is held."""
    stream, version = io.BytesIO(data) if isinstance(data, bytes) else data, None
    while raw := stream.readline():
        if raw == b"\n":  # the line end between records
            continue
        if not raw.endswith(b"\n"):
            raise ArchiveError("a header line has no end")
        line = raw[:-1].decode("utf-8", errors="replace").rstrip("\r")
        parts = line.split(" ")
        if version is None:
            if not line.startswith("filedesc://"):
                raise ArchiveError("the file has no describing record")
        elif len(parts) != len(FIELDS[version]):
            raise ArchiveError(f"version {version} wants {len(FIELDS[version])} fields: {line[:80]!r}")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ArchiveError(f"no length: {line[:80]!r}") from None
        block = stream.read(length) if length >= 0 else b""
        if length < 0 or len(block) != length:
            raise ArchiveError("a declared length exceeds the file")
        if version is None:
            found = re.match(rb"(\d+) ", block)
            version = int(found[1]) if found else 0
            if version not in FIELDS:
                raise ArchiveError(f"unknown version {version}")
        else:
            yield ArcRecord(dict(zip(FIELDS[version], parts)), block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP message, its closing blank line included, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def timestamp(date: str) -> str:
    """ISO form of an ARC date of 4 to 14 digits; missing parts are the least ones."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += EPOCH[len(digits) :] if len(digits) >= 4 else EPOCH
    try:
        at = datetime.strptime(digits[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        at = datetime.strptime(EPOCH, "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, date: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {date} {url}')}>"


def to_warc(record: ArcRecord, key: str = "", refers_to: str | None = None, source: str = "") -> bytes:
    """The WARC record without its closing line ends.  With ``refers_to`` it is
    a revisit: the head of the message alone, and the digest of the full payload.
    ``key`` is the row of a table it comes from, ``source`` the place in an archive."""
    h = record.header
    head, payload = split_http(record.block)
    url, kind = h["url"], "response" if head else "resource"
    block = head + payload
    lines = ["WARC/1.1"]
    if refers_to is not None:
        kind, block = "revisit", head
    lines += [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(url, h['date'], source or key)}", f"WARC-Date: {timestamp(h['date'])}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {h['ip']}"]
    lines += [f"X-Row-Key: {key}"] if key else [f"X-Source: {source}"] if source else []
    lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else h['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ArchiveError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", errors="replace").split("\r\n")[1:])}
        n = int(headers["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ArchiveError(f"the record at byte {at} does not end where it says")
        yield headers, block
        at = end + 8 + n


def http_message(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def _digest():
    return F.sha2(F.encode("html", "utf-8"), 256)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha, refers_to) of ``pages`` (page_id, html): pages with a payload
    of ``LEAST_REVISIT`` bytes or more that a page with a larger id repeats."""
    prints = pages.select("page_id", _digest().alias("sha"), F.octet_length("html").alias("n")).where(f"n >= {LEAST_REVISIT} AND page_id IS NOT NULL")
    last = stored(prints.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").select("sha", "refers_to"))
    return prints.join(last, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def _bundled(records: Iterator[bytes], limit: int) -> Iterator[pa.RecordBatch]:
    """Records, closed by what follows each, in cells of up to ``limit`` bytes."""
    held, size = [], 0
    for record in records:
        if held and size + len(record) > limit:
            yield pa.record_batch([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])
            held, size = [], 0
        held.append(record)
        size += len(record) + 4
    if held:
        yield pa.record_batch([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])


def _write(bundles: DataFrame, path: str) -> None:
    """A file for each bundle.  The cast leaves bytes alone, and so does the writer."""
    bundles.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, version: int = 1) -> None:
    """Writes a WARC record per row of ``pages`` (page_id, url, html) into files
    of ``path``: each page is put as an ARC record, parsed, and converted.

    Null and empty pages have an empty payload; repeated rows, null ids and equal
    payloads are written one by one, those that ``revisits`` names as revisits;
    no rows give no records.  Other columns are never read.
    """
    clean = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches):
        def records():
            for b in pieces(batches):
                for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                    arc = arc_file_header(version) + arc_record(version, url, EPOCH, "text/html", http_message(html.encode())) + b"\n"
                    (record,) = read_arc(arc)
                    yield to_warc(record, "" if page is None else str(page), None if refers is None else f"urn:page:{refers}")

        yield from _bundled(records(), FILE_BYTES)

    again = stored(revisits(clean))
    key = F.xxhash64("page_id", "sha")
    seen = marked(clean.withColumn("sha", _digest()), key, slots(again.select(key.alias("h"))), "again")
    once = seen.where("NOT again").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))  # stays where it is
    rows = once.unionByName(seen.where("again").join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to"))
    _write(rows.mapInArrow(run, "value binary"), path)


def convert(spark: SparkSession, source: str, path: str) -> None:
    """Converts every ARC file of the folder ``source`` (``.arc``, or ``.arc.gz`` with
    a member per record or one in all) into WARC files below ``path``.

    Payloads are kept byte by byte, records that repeat are written again; a
    folder without such files gives none.  A damaged file is an ``ArchiveError``.
    A compressed file is read as it streams; a file has to fit in a cell (2 GiB).
    """

    def run(batches):
        def records():
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = content.as_py()
                    stream = gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                    try:
                        for i, record in enumerate(read_arc(stream)):
                            yield to_warc(record, source=f"{name.rpartition('/')[2]}:{i}")
                    except (EOFError, OSError) as error:
                        raise ArchiveError(f"{name}: {error}") from None

        yield from _bundled(records(), FILE_BYTES)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{arc,arc.gz}").load(source)
    _write(found.select("path", "content").mapInArrow(run, "value binary"), path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, record_id, date, uri, payload) of every record below ``path``.
    A response's digest and length are taken from its payload, and must be those it
    declares.  Empty payloads, repeated records and records without a row's id are
    rows like any other; no files give no rows."""
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "date", "uri", "payload"]
    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, date string, uri string, payload binary"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def rows(data: bytes):
        for h, block in read_warc(data):
            payload = split_http(block)[1]
            n, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-type"] != "revisit" and (len(payload), hashlib.sha1(payload).hexdigest()) != (n, digest):
                raise ArchiveError(f"a payload is not what {h['warc-record-id']} declares")
            refers = h.get("warc-refers-to")
            key = h.get("x-row-key")
            yield (int(key) if key else None, h["warc-type"], n, digest, int(refers.rpartition(":")[2]) if refers else None, h["warc-record-id"], h["warc-date"], h["warc-target-uri"], payload if h["warc-type"] != "revisit" else None)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                held, size = [], 0
                for row in rows(b.column(0)[i].as_py()):
                    held.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 4 << 20:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), types)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Pages with a null or empty payload are responses of zero bytes; a null
    page_id is written and read as none and neither revisits nor is revisited;
    rows alike in id and payload are both what their id is."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = stored(read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    removed(spark, path)
    return rows


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT t, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON n >= 1000 AND p.t = m.t
"""
