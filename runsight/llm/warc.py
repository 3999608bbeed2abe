"""WARC archives: writing, and a reader that salvages damaged files.

Written archives hold one gzip member per record. The reader takes any mix of gzip members and plain records. Where a record fails a check (gzip error, no version line, bad headers, length or digest that
does not match) it searches for the next place that can start a record, a gzip magic number or a version line at which a whole record passes, and goes on there. The bytes between are
logged as a gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.llm import sharedfiles
from runsight.llm.batches import small_batches
from runsight.session import materialize

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")

ARCHIVE_BYTES = 32 << 20
#: Bytes given to the decompressor at a time; what it does not need of them is copied.
CHUNK = 1 << 14
RECORDS = "path string, offset long, length long, record_type string, record_id string, target string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"
GAPS = "path string, offset long, length long, reason string"


def digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A header value must stay on its line."""
    return re.sub(r"[\r\n]+", " ", value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record."""
    lines = [VERSION.decode(), *[f"{k}: {_header(v)}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member; its header carries no time, so equal records give equal bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_record(page_id: int, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names the response with the same payload. Both carry the payload's digest and length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", datetime.fromtimestamp(0, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("WARC-Payload-Digest", "sha1:" + sha),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record(headers, block)


class Damaged(Exception):
    """Why a record cannot be taken from a place."""


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and the place behind it; Damaged if any check fails."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    end = re.compile(rb"\r?\n\r?\n").search(data, line.end() - 1)
    if not end:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for row in re.split(rb"\r?\n", data[line.end() : end.start()]):
        name, colon, value = row.partition(b":")
        key = name.strip().lower().decode("latin-1")
        if not colon or b"\r" in row or key in ("content-length", "warc-type") and key in headers:
            raise Damaged("bad header line")
        headers[key] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    stop = end.end() + int(headers["content-length"])
    block = data[end.end() : stop]
    if stop > len(data):
        raise Damaged("truncated block")
    tail = re.compile(rb"\r?\n\r?\n").match(data, stop)
    if not tail:
        raise Damaged("no record end")
    wanted = headers.get("warc-block-digest", "").removeprefix("sha1:")
    if wanted and digest(block) != wanted:
        raise Damaged("block digest")
    http = headers.get("content-type", "").startswith("application/http")
    head, split, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    if http and not split:
        raise Damaged("no HTTP header")
    kind, sha = headers.get("warc-type", ""), headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        told = re.search(rb"(?im)^content-length:\s*([0-9]+)", head)
        size = int(told[1]) if told else None
    elif sha and digest(payload) != sha:
        raise Damaged("payload digest")
    found = {
        "record_type": kind,
        "record_id": headers.get("warc-record-id"),
        "target": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "payload_digest": sha or None,
        "refers_to": headers.get("warc-refers-to"),
        "payload_bytes": size,
        "payload": None if kind == "revisit" else payload,
    }
    return found, tail.end()


def _take(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records that start at ``at``, and the place behind them: one plain record, or all records of one gzip member."""
    if not data.startswith(GZIP, at):
        found, end = _parse(data, at)
        return [found], end
    unpack, parts, end = zlib.decompressobj(31), [], at
    while not unpack.eof:
        chunk = data[end : end + CHUNK]
        if not chunk:
            raise Damaged("truncated gzip member")
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error as error:
            raise Damaged("gzip data") from error
        end += len(chunk)
    end -= len(unpack.unused_data)
    plain = b"".join(parts)
    found, inside = [], 0
    while inside < len(plain):
        one, inside = _parse(plain, inside)
        found.append(one)
    if not found:
        raise Damaged("empty gzip member")
    return found, end


def salvage(data: bytes) -> Iterator[dict]:
    """Records (with offset and length) and gaps (offset, length, reason) of one archive in order; together they cover all bytes."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            found, end = _take(data, at)
        except Damaged as why:
            if lost is None:
                lost, reason = at, str(why)
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if lost is not None:
            yield {"offset": lost, "length": at - lost, "reason": reason}
            lost = None
        for one in found:
            yield one | {"offset": at, "length": end - at}
        at = end
    if lost is not None:
        yield {"offset": lost, "length": at - lost, "reason": reason}


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (html as UTF-8, null as empty), sha (hex), refers_to: of pages with equal payloads of ``least_bytes`` or more the largest page_id,
    null for that page itself, for smaller payloads and for pages without an id.

    Copies are counted per task before the shuffle; only payloads that occur twice are joined back.
    """
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    copies = hashed.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("sha", "original")
    refers = F.when((F.col("page_id") != F.col("original")) & (F.octet_length("payload") >= least_bytes), F.col("original"))
    return hashed.join(copies, "sha", "left").select("page_id", "url", "payload", "sha", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page into gzip archives below ``folder``; returns path, n_records, n_bytes of each archive.

    Null html counts as empty; a null page_id is written as ``None``; rows that share a page_id each get a record, and those with the same payload are all responses
    if the id is the largest. An empty table gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, done = TaskContext.get().partitionId(), [], 0, []

        def close() -> None:
            nonlocal size
            done.append((sharedfiles.put(folder, f"{part}-{len(done)}.warc.gz", b"".join(held)), len(held), size))
            held.clear()
            size = 0

        for batch in batches:
            for page, url, payload, sha, refers in zip(*batch.columns):
                sha = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                held.append(member(page_record(page.as_py(), url.as_py(), payload.as_py(), sha, refers.as_py())))
                size += len(held[-1])
                if size >= archive_bytes:
                    close()
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "n_records", "n_bytes"])

    return materialize(with_originals(small_batches(pages), least_bytes).mapInArrow(write, "path string, n_records long, n_bytes long"))


def _read(files: DataFrame, columns: str, gaps: bool) -> DataFrame:
    """``files``: path and content, or path alone for files in the shared folder."""
    names, held = [c.split()[0] for c in columns.split(", ")], "content" in files.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path = batch.column(0)[row].as_py()
                rows: list[dict] = []
                size = 0
                for one in salvage(batch.column(1)[row].as_py() if held else sharedfiles.get(path)):
                    if ("reason" in one) == gaps:
                        rows.append({"path": path} | one)
                        size += 1000 + len(one.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, columns.split(", "))])
    return files.mapInArrow(read, columns)


def archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content of any archives; each may have up to 2 GiB."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def records(files: DataFrame) -> DataFrame:
    """All records that pass every check, with their payloads (null for revisits)."""
    return _read(files, RECORDS, gaps=False)


def quarantine(files: DataFrame) -> DataFrame:
    """The byte ranges that hold no valid record, with the first reason for each."""
    return _read(files, GAPS, gaps=True)


def page_rows(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records written by ``write_archives``."""
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))

