"""WARC archives: a writer with one gzip member per record, and a sequential reader.

The reader inflates a file piece by piece, frames each record by its
Content-Length and verifies block and payload digests as the bytes pass, so it
holds one record and one piece at most. Archives go to the folder that driver
and executors share, under names that no second attempt of a task reuses; the
manifest, written after the files, lists those of successful attempts alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, delete

PIECE = 1 << 18
ROLL_BYTES = 256 << 20
LEVEL = 5
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


class WarcError(ValueError):
    """A record that is cut short, badly framed or whose digest differs."""


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The page id in a record id, None for that of a page without one."""
    number = (name or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One gzip member: a response with the payload, or a revisit of refers_to with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{digest32(hashlib.sha1(payload).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    """A record as read: its headers, the HTTP head and the payload that stands in it."""

    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in lines if x)}


def _members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member in order, an iterator of its inflated pieces, to be used up before the next."""
    rest = b""
    while True:
        raw = rest or stream.read(PIECE)
        if not raw:
            return
        unpacker, rest = zlib.decompressobj(31), b""

        def pieces(unpacker=unpacker, raw=raw):
            nonlocal rest
            while True:
                try:
                    out = unpacker.decompress(raw, PIECE)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                if out:
                    yield out
                if unpacker.eof:
                    rest = unpacker.unused_data
                    return
                raw = unpacker.unconsumed_tail or stream.read(PIECE)
                if not raw:
                    raise WarcError("the file ends inside a record")

        yield pieces()


def _take_head(held: bytearray, pieces: Iterator[bytes]) -> list[bytes]:
    """Lines up to the first empty one, taken off held, which is filled as needed."""
    sought = 0
    while (end := held.find(b"\r\n\r\n", sought)) < 0:
        sought = max(0, len(held) - 3)
        if (more := next(pieces, None)) is None:
            raise WarcError("a record's head has no end")
        held += more
    lines = bytes(held[:end]).split(b"\r\n")
    del held[: end + 4]
    return lines


def read_records(stream) -> Iterator[Record]:
    """The records of one archive in order; WarcError at the first that is cut short, ill-framed or altered."""
    for pieces in _members(stream):
        held = bytearray()
        version, *lines = _take_head(held, pieces)
        if not version.startswith(b"WARC/1."):
            raise WarcError(f"no WARC record: {version[:20]!r}")
        found = Record(_headers(lines))
        try:
            length = int(found.headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record has no Content-Length") from e
        block = bytearray()
        sha = hashlib.sha1()
        while True:
            part = held[: length - len(block)]
            sha.update(part)
            block += part
            del held[: len(part)]
            if len(block) == length:
                break
            if (more := next(pieces, None)) is None:
                raise WarcError("a record is shorter than its Content-Length")
            held += more
        for more in pieces:
            held += more
        if held != b"\r\n\r\n":
            raise WarcError("a record does not end after its Content-Length")
        _verify(found.headers.get("warc-block-digest"), sha.digest(), "block")
        if "application/http" in found.headers.get("content-type", ""):
            _, *lines = _take_head(block, iter(()))
            found.http = _headers(lines)
        found.payload = bytes(block)
        if found.kind == "response":
            _verify(found.headers.get("warc-payload-digest"), hashlib.sha1(found.payload).digest(), "payload")
        yield found


def _verify(stated: str | None, sha1: bytes, what: str) -> None:
    if stated is not None and stated.removeprefix("sha1:") != digest32(sha1):
        raise WarcError(f"the {what} digest differs: {stated}")


def _write(root: str):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            done.append((f"{root}/{name}", records, size))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                member = record(page_id, url, (html or "").encode(), refers_to)
                if out is not None and size + len(member) > ROLL_BYTES:
                    close()
                    out = None
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); a DataFrame of path, records and bytes per archive.

    Of rows whose payloads (html in UTF-8, null as empty) are equal and have at
    least `least_bytes` bytes, that with the least page_id is the response and the
    others revisit it; all others are responses. A null page_id is never
    deduplicated, rows that repeat the least page_id are responses, a null url
    leaves out the target URI. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    groups = rows.where(f"page_id is not null and octet_length(html) >= {least_bytes}").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    met = F.when(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes) & (F.col("page_id") != F.col("first")), F.col("first"))
    marked = rows.join(groups, "sha", "left").select("page_id", "url", "html", met.alias("refers_to"))
    root = _uri(scratch, f"{scratch.path}/archives")
    return scratch.keep(marked.mapInArrow(_write(root), "path string, records long, bytes long"), "manifest")


def _uri(scratch: Scratch, path: str) -> str:
    """The path with its file system's scheme, as every executor can open it."""
    spark = scratch.spark
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + full.removeprefix("file:").removeprefix("//") if full.startswith("file:") else full


def _read(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as stream:
                    rows, weight = [], 0
                    for r in read_records(stream):
                        revisit = r.kind == "revisit"
                        size = int(r.http.get("content-length", 0)) if revisit else len(r.payload)
                        row = (page_of(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), size, r.headers["warc-payload-digest"].removeprefix("sha1:"), r.kind, page_of(r.headers.get("warc-refers-to")) if revisit else None)
                        rows.append(row + (r.payload,) * with_payload)
                        weight += 200 + len(r.payload) * with_payload
                        if weight > 4 << 20:
                            yield _batch(rows, schema)
                            rows, weight = [], 0
                    if rows:
                        yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per record of the listed archives (column path), a task per archive or several."""
    spread = manifest.select("path").repartition(max(1, manifest.count()))
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread.mapInArrow(_read(with_payload), columns + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What read_archives finds in the archives that write_archives makes of pages; the archives are then removed."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, scratch, least_bytes)
    found = scratch.keep(read_archives(manifest).drop("url"), "records")
    delete(scratch.spark, f"{scratch.path}/archives")
    return found
