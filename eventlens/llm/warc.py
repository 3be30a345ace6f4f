"""WARC archives: a writer with revisit records, and a salvage reader.

The writer puts each page into a record of its own compressed member. Of pages with equal payloads of at least
`MIN_REVISIT` bytes the one with the largest id is written in full (`response`), the others refer to
it (`revisit`) and keep only their headers. A task writes archives of at most `ARCHIVE_BYTES`
(one record more at most) under names that no other attempt uses; the manifest, a Parquet table that Spark commits, lists
those that count, so lost executors and repeated tasks leave no doubt.

The reader streams an archive in pieces. After a failed check (damaged member, bad version line,
lengths that do not fit, digest that differs) it goes on at the next place where a member or a version line
starts that can be read, recovers the records from there on, and logs the byte gap in between as quarantined.

Nulls: null html is an empty payload; null urls are empty; pages without id are written in full and read back without id.
Equal ids with equal payloads are all `response`. Other columns are ignored; an empty table gives an empty result.
Payloads are written and checked whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import shared_path, stored, table

MIN_REVISIT = 1000
MOST_TASKS = 10_000
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_ID = "urn:page:"
DATE = "2024-01-01T00:00:00Z"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to) for pages whose payload another page holds in full."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.filter(F.octet_length(payload) >= MIN_REVISIT).select("page_id", F.sha1(payload).alias("digest"))
    full = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    full = full.filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    found = rows.join(full, "digest").filter(F.col("page_id") < F.col("refers_to"))
    return found.select("page_id", "digest", "refers_to").distinct()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, its HTTP header included. A revisit has the header but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{_ID}{page_id}" if page_id is not None else f"{_ID}none:{uuid.uuid4().hex}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{_ID}{refers_to}>")
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives below `folder`; the manifest (path, records, bytes), stored."""
    marks = revisits(pages).withColumnRenamed("page_id", "id")
    payload_digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    same = (F.col("page_id") == F.col("id")) & (payload_digest == F.col("digest"))
    rows = pages.select("page_id", "url", "html").join(marks, same, "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, path, count, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    path, count, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                data = record(page_id.as_py(), url.as_py() or "", (html.as_py() or "").encode(), refers_to.as_py())
                member = gzip.compress(data, 6, mtime=0)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Part:
    """A part of a stream, by its absolute places; what lies before `at` is forgotten."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.data, self.at, self.ended = stream, b"", 0, False

    def grow(self) -> bool:
        piece = b"" if self.ended else self.stream.read(PIECE)
        self.ended = self.ended or not piece
        self.data += piece
        return bool(piece)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


class Broken(ValueError):
    """What is at this place is no readable record."""


def _member(part: Part) -> tuple[bytes, int]:
    """The content of the compressed member at the part's start, and its length."""
    inflate, content, used = zlib.decompressobj(31), [], 0
    try:
        while True:
            if used == len(part.data) and not part.grow():
                raise Broken("member cut off")
            piece = part.data[used:]
            content.append(inflate.decompress(piece))
            used = len(part.data) - len(inflate.unused_data)
            if inflate.eof:
                return b"".join(content), used
    except zlib.error as error:
        raise Broken(str(error)) from error


def parsed(data: bytes) -> tuple[dict, bytes, int]:
    """Headers, block and length of the record that `data` starts with; raises Broken or, if short, EOFError."""
    if not data.startswith(_VERSION):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n")
    if data.find(b"\n" + _VERSION, 0, end if end >= 0 else len(data)) >= 0:  # of any length, but not into the next record
        raise Broken("no header end")
    if end < 0:
        raise EOFError
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise Broken("bad version")
    headers = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Broken("no length")
    stop = end + 4 + int(headers["content-length"])
    if len(data) < stop + 4:
        raise EOFError
    block = data[end + 4 : stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("length does not fit")
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Broken("digest differs")
    return headers, block, stop + 4


def salvage(stream: BinaryIO) -> Iterator[tuple[str, int, int, dict, bytes]]:
    """("record", start, end, headers, block) and ("gap", start, end, {"reason"}, b"") in file order.

    Records may be compressed, one to a member, or plain.
    """
    part, gap, reason = Part(stream), None, ""

    def closed() -> Iterator[tuple[str, int, int, dict, bytes]]:
        if gap is not None and part.at > gap:
            yield "gap", gap, part.at, {"reason": reason}, b""

    while part.data or part.grow():
        while len(part.data) < len(_VERSION) and part.grow():
            pass
        try:
            if part.data.startswith(_MEMBER):
                content, used = _member(part)
                try:
                    headers, block, length = parsed(content)
                except EOFError:
                    raise Broken("record cut off") from None
                if length != len(content):
                    raise Broken("more than a record in a member")
            elif part.data.startswith(_VERSION):
                while True:
                    try:
                        headers, block, used = parsed(part.data)
                        break
                    except EOFError:
                        if not part.grow():
                            raise Broken("record cut off") from None
            else:
                raise Broken("neither member nor version line")
        except Broken as error:
            if gap is None:
                gap, reason = part.at, str(error)
            _resync(part)
            continue
        yield from closed()
        gap = None
        yield "record", part.at, part.at + used, headers, block
        part.skip(used)
    yield from closed()


def _resync(part: Part) -> None:
    """Moves on, by a byte at least, to the next place where a member or version line may start."""
    at = 1
    while True:
        found = [k for k in (part.data.find(_MEMBER, at), part.data.find(_VERSION, at)) if k >= 0]
        if found:
            part.skip(min(found))
            return
        keep = min(len(part.data), len(_VERSION) - 1)
        part.skip(max(1, len(part.data) - keep) if len(part.data) > keep else 0)
        at = 0
        if not part.grow():
            part.skip(len(part.data))
            return


READ = (
    "path string, kind string, start long, end long, reason string, page_id long, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def _page(name: str) -> int | None:
    match = re.fullmatch(rf"<{_ID}(-?[0-9]+)>", name)
    return int(match[1]) if match else None


def _row(path: str, kind: str, start: int, end: int, headers: dict, block: bytes) -> dict:
    row = dict.fromkeys(part.split()[0] for part in READ.split(", "))
    row |= {"path": path, "kind": kind, "start": start, "end": end, "reason": headers.get("reason")}
    if kind == "gap":
        return row
    head, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\nContent-Length:\s*([0-9]+)", head)
    digest = headers.get("warc-payload-digest", "")
    bare = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    response = headers.get("warc-type") == "response"
    if response and hashlib.sha1(payload).hexdigest() != bare:
        return row | {"kind": "gap", "reason": "payload digest differs"}
    return row | {
        "page_id": _page(headers.get("warc-record-id", "")),
        "payload_bytes": len(payload) if response else int(said[1]) if said else None,
        "payload_digest": bare,
        "record_type": headers.get("warc-type"),
        "refers_to": _page(headers.get("warc-refers-to", "")),
    }


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of kind `record` and `gap` of all archives in the stored `manifest` (column `path`), about an archive to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                with system.open_input_stream(path, compression=None) as stream:
                    for found in salvage(stream):
                        rows.append(_row(path, *found))
                        if len(rows) == 1000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    # a number of partitions that is given is not made smaller, however few bytes the manifest has
    tasks = min(MOST_TASKS, max(1, manifest.count()))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, READ)


def all_records(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records among the stored rows `found`; an error if they are not as many as the manifest says were written."""
    records = found.filter(F.col("kind") == "record")
    written, read = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if written != read:
        raise ValueError(f"{written} records were written, {read} could be read back")
    return records


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in READ.split(", ")])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    found = stored(read_archives(manifest, folder), "warc-rows")
    return all_records(found, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS digest FROM pages
), marked AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, digest, CASE WHEN octet_length(payload) >= 1000
    THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS full_id
  FROM rows
)
SELECT page_id, payload_bytes, digest AS payload_digest,
  CASE WHEN page_id < full_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < full_id THEN full_id END AS refers_to
FROM marked
"""
