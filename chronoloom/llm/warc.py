"""WARC archives: a writer with revisit records and a sequential reader.

Every record is one gzip member. The reader takes bytes as they come, inflates one member at a time,
frames the block by Content-Length and checks the payload and block digests; it holds one record, never
an archive. Archives go to the folder that all executors share, under names a retried task doesn't
reuse; only the manifest, a table committed by Spark, says which of them count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm._shared import cut, scratch_path, stored

REVISIT_FROM = 100  # bytes of payload from which a repeated payload is stored once
ARCHIVE_BYTES = 32 << 20  # compressed bytes after which the next archive begins
BROADCAST_ROWS = 100_000  # repeated payloads sent to every executor at most; more are joined
READ = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _target(url: str | None) -> str:
    return quote(url or "about:blank", safe=";/?:@&=+$,-_.!~*'()#[]%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response, or a revisit of refers_to without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    own = "none" if page_id is None else str(page_id)
    unique = own if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {digest}").hex
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{unique}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url)}",
        f"X-Page-ID: {own}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive given as byte chunks of any size.

    Raises ValueError on a broken member, a wrong length, a wrong digest or an archive that ends in a record.
    """
    pending = b""
    inflate, data = None, bytearray()
    chunks = iter(chunks)
    while True:
        if not pending:
            pending = next(chunks, b"")
            if not pending:
                break
        if inflate is None:
            inflate, data = zlib.decompressobj(31), bytearray()
        try:
            data += inflate.decompress(pending)
        except zlib.error as e:
            raise ValueError(f"broken gzip member: {e}") from None
        pending = inflate.unused_data
        if inflate.eof:
            yield _framed(bytes(data))
            inflate = None
    if inflate is not None:
        raise ValueError("the archive ends inside a record")


def _framed(data: bytes) -> tuple[dict[str, str], bytes]:
    at = data.find(b"\r\n\r\n")
    if at < 0:
        raise ValueError("a record without the end of its headers")
    headers = _headers(data[:at])
    size = int(headers["content-length"])
    block, rest = data[at + 4 : at + 4 + size], data[at + 4 + size :]
    if len(block) != size or rest != b"\r\n\r\n":
        raise ValueError(f"{headers.get('warc-record-id')}: Content-Length {size} doesn't frame the block")
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["warc-block-digest"]:
        raise ValueError(f"{headers.get('warc-record-id')}: wrong block digest")
    return headers, block


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """A RECORD row; the payload of a response is held against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    kind = headers["warc-type"]
    said = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']}: wrong payload length or digest")
    refers = headers.get("warc-refers-to")
    own = headers["x-page-id"]
    return (
        None if own == "none" else int(own),
        headers["warc-target-uri"],
        kind,
        said,
        digest,
        int(refers.removeprefix("<urn:x-page:").removesuffix(">")) if refers else None,
        payload if kind == "response" else None,
    )


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html, payload_digest, refers_to); one row per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, _ = _filesystem(folder)
        out, n, count, size = None, 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{name}-{n:05d}.warc.gz"
                    out, count, size, n = system.open_output_stream(_filesystem(path)[1], compression=None), 0, 0, n + 1
                data = member(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["payload_digest"], row["refers_to"]))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "n_records"])

    system, at = _filesystem(folder)
    system.create_dir(at, recursive=True)
    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, MANIFEST)


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the archives named in manifest.path, as RECORD rows (payload null unless asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _filesystem(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as f:
                    for headers, block in records(iter(lambda f=f: f.read(READ), b"")):
                        row = parsed(headers, block)
                        rows.append(row if payload else (*row[:-1], None))
                        size += len(block) if payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD)


def with_revisits(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Adds payload_digest and refers_to: of rows with equal payloads of at least revisit_from bytes, the one
    with the smallest page_id is stored, the others refer to it.

    Rows that share the smallest page_id are all stored; a row without page_id is stored and never referred to.
    Null html is the empty payload. Only repeated payloads are joined, by digest, so a payload that a third of
    all rows share is one small row on the other side.
    """
    html = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).alias("_bytes"))
    repeated = cut(
        named.filter((F.col("_bytes") >= revisit_from) & F.col("page_id").isNotNull())
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
        .filter("_first < _last")
        .select("_digest", "_first")
    )
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = named.join(repeated, (F.col("payload_digest") == F.col("_digest")) & (F.col("page_id") > F.col("_first")), "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.col("_first").alias("refers_to"))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives pages in folder (a new one in the shared folder if none is given); the stored manifest."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest, _ = stored(write_archives(with_revisits(pages), folder), "warc-manifest")
    return manifest
