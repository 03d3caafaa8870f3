"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

The writer decides by payload digest which page of a group of equal payloads is the
response and which revisit it; each task then appends records to archives of bounded
size. An archive counts only once its task has named it in the manifest, so a repeated or
lost task leaves files that nobody reads.

The reader takes archives one to a task slot, inflates them in small pieces, member by
member, frames each block by its content length and verifies the digests it finds.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import keep_until_exit, stored
from tidelake.session import scratch

SMALL = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def open_store(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder as tasks reach it; Hadoop's s3a is the same store as s3."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters become percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value).strip()


def record(page: dict, date: str) -> bytes:
    """One gzip member. A revisit holds the HTTP head alone, a response the payload as well."""
    payload = page["payload"].encode("utf-8")
    revisit = page["refers_to"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{'' if page['page_id'] is None else page['page_id']}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(page["url"] or "about:blank")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Payload-Digest", _digest(payload)),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{page['refers_to']}>")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, refers_to: null for a response.

    The groups are counted map-side and written, so that the join with them can split a
    group that holds a large share of the pages.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    )
    digest = F.when(F.octet_length("payload") >= SMALL, F.sha2("payload", 256))
    groups = (
        rows.select("page_id", digest.alias("digest"))
        .filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    rows = rows.withColumn("digest", digest)
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(stored(groups, "warc-groups"), "digest", "left").select(
        "page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write every page and return the manifest (archive, records), itself a written table.

    A null html is an empty payload, a null url about:blank. Of equal payloads of at least
    100 bytes that with the smallest page_id is the response; rows that repeat that id and
    payload are responses too, and a group of null ids only has no revisits. An archive is closed when it reaches archive_bytes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out: BinaryIO | None = None
        name, size, count = "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    planned = plan_records(pages, id_col, url_col, html_col)
    return stored(planned.mapInArrow(run, "archive string, records long"), "warc-manifest")


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; each must be used up before the next."""
    pending = stream.read(CHUNK)
    while pending:
        unpacker = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal pending
            while not unpacker.eof:
                if not pending:
                    raise ValueError("the archive ends inside a record")
                data = unpacker.decompress(pending, CHUNK)
                pending = unpacker.unconsumed_tail or unpacker.unused_data or stream.read(CHUNK)
                if data:
                    yield data

        yield pieces()
        if not unpacker.eof:
            raise ValueError("a record was left before its end")


class _Framed:
    """Reads a member's pieces by line and by length."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data = pieces, b""

    def upto(self, mark: bytes) -> bytes:
        while mark not in self.data:
            more = next(self.pieces, None)
            if more is None:
                raise ValueError("a header has no end")
            self.data += more
        found, self.data = self.data.split(mark, 1)
        return found

    def exactly(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.data:
                self.data = next(self.pieces, b"")
                if not self.data:
                    raise ValueError("a block is shorter than its content length")
            piece, self.data = self.data[:length], self.data[length:]
            length -= len(piece)
            yield piece

    def rest(self) -> bytes:
        out, self.data = self.data + b"".join(self.pieces), b""
        return out


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """Every record of an archive in order, digests verified; a fault raises ValueError."""
    for pieces in members(stream):
        framed = _Framed(pieces)
        lines = framed.upto(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        whole, body = hashlib.sha256(), bytearray()
        for piece in framed.exactly(int(fields["Content-Length"])):
            whole.update(piece)
            body += piece
        if framed.rest() != b"\r\n\r\n":
            raise ValueError("a record does not end after its block")
        head, _, payload = bytes(body).partition(b"\r\n\r\n")
        if fields["WARC-Block-Digest"] != "sha256:" + base64.b32encode(whole.digest()).decode():
            raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
        kind = fields["WARC-Type"]
        if kind == "response" and fields["WARC-Payload-Digest"] != _digest(payload):
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
        ids = [fields.get(n, "<urn:page:>")[1 + len(_ID) : -1] for n in ("WARC-Record-ID", "WARC-Refers-To")]
        yield {
            "page_id": int(ids[0]) if ids[0] else None,
            "url": fields["WARC-Target-URI"],
            "record_type": kind,
            "payload": payload if kind == "response" else None,
            "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][7:]).hex(),
            "refers_to": int(ids[1]) if ids[1] else None,
        }


def read_archives(manifest: DataFrame, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, record_type, payload (null for revisits), payload_digest, refers_to of all records.

    Archives are dealt out one by one; only those the manifest names are read.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
         ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        rows, size = [], 0
        for batch in batches:
            for name, expected in zip(*(batch.column(c).to_pylist() for c in ("archive", "records"))):
                count = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for row in read_records(stream):
                        rows.append(row)
                        count += 1
                        size += len(row["payload"] or b"")
                        if size >= batch_bytes or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{name} holds {count} of {expected} records")
        yield pa.RecordBatch.from_pylist(rows, schema)

    spread = manifest.repartition(max(1, manifest.count()))
    return spread.mapInArrow(
        run, "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long"
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with payload_bytes; a revisit takes them from the response it refers to."""
    sized = records.withColumn("own", F.octet_length("payload").cast("long")).drop("payload")
    responses = (
        sized.filter("record_type = 'response'")
        .groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("with"))
        .agg(F.max("own").alias("theirs"))
    )
    same = (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("with"))
    return sized.join(stored(responses, "warc-responses"), same, "left").select(
        "page_id", F.coalesce("own", "theirs").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages and describe what the archives hold: one row per page."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, **options)
    keep_until_exit(pages.sparkSession, folder)
    return resolve_revisits(read_archives(manifest, folder))
