"""WARC archives: a writer with revisit records, and a reader that splits compressed files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import Workspace, partitions

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
BLOCK = 1 << 20  # bytes read ahead at a time
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, path string, at long"
)


def plan_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with payload, digest, record type and the response that a revisit refers to.

    Only digests that occur more than once are joined back, as one row each made by an
    aggregate that combines ahead of the shuffle. The join is an inner or left one on the digest,
    which adaptive execution splits where a third of the pages share a payload.
    """
    known = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary"))
    )
    repeated = (
        known.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id")).filter("n > 1").drop("n")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.join(repeated, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def _record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    payload = html.encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    code = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{code}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += [f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write one gzip member a record; returns (path, bytes, records) of the files.

    A file's name holds a fresh id, so a task that runs twice writes two files, of which only
    the finished attempt's is listed. Lazy: the caller writes the listing once and reads that.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, sink, size, n = "", None, 0, 0
        done = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for row in zip(*cols, strict=True):
                if sink is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                member = _record(*row)
                sink.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    sink.close()
                    done.append((f"{folder}/{name}", size, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["path", "bytes", "records"],
            )

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(
        write, "path string, bytes long, records long"
    )


def _member(source: pa.NativeFile, at: int, head: bytes, size: int) -> tuple[bytes, int] | None:
    """A member's bytes and length, if one starts at ``at``; ``head`` is what is known from there.

    The candidate's first bytes must inflate to a record's version line before the rest is read.
    """
    unpack, out, pos = zlib.decompressobj(31), [], 0
    checked = False
    chunk = head
    while True:
        try:
            out.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        pos += len(chunk)
        if not checked:
            start = b"".join(out)
            if len(start) >= 7 or unpack.eof:
                if not start.startswith(b"WARC/1."):
                    return None
                checked = True
        if unpack.eof:
            return b"".join(out), pos - len(unpack.unused_data)
        if at + pos >= size:
            return None
        source.seek(at + pos)
        chunk = source.read(BLOCK)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    kind = fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
        size = len(payload)
    else:
        size, payload = int(_fields(http)["content-length"]), None
    return page("warc-record-id"), fields.get("warc-target-uri"), kind, page("warc-refers-to"), size, digest, payload


def read_archives(files: DataFrame, split_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """Records of WARC files listed as (path, bytes), one row each.

    Files are cut into byte ranges, each a row that goes to some task. A task looks for the gzip
    magic in its range, inflates the head of each candidate, and takes a member as a record
    only if that gives a WARC version line; it owns the records that start inside its range and
    reads the last one past the range's end. No index is needed. A false magic costs a few bytes.
    """
    ranges = files.filter("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "path", "at"]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        held, weight = [], 0
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                end = min(start + split_bytes, size)
                with store.open_input_file(name) as source:
                    at, base, buffer = start, start, b""
                    while at < end:
                        if at + 3 > base + len(buffer):  # the magic may lie across two reads
                            source.seek(at)
                            base, buffer = at, source.read(BLOCK)
                        found = buffer.find(MAGIC, at - base)
                        if found < 0:
                            at = max(at + 1, base + len(buffer) - 2)
                            if base + len(buffer) >= size:
                                break
                            continue
                        at = base + found
                        if at >= end:
                            break
                        member = _member(source, at, buffer[found:], size)
                        if member is None:
                            at += 1
                            continue
                        data, length = member
                        row = _parse(data)
                        held.append((*row[:6], row[6] if payloads else None, path, at))
                        weight += len(data) if payloads else 200
                        at += length
                        if weight > 8 << 20:
                            yield rows(held)
                            held, weight = [], 0
        if held:
            yield rows(held)

    return ranges.repartition(partitions(files.sparkSession)).mapInArrow(read, RECORDS)


def archive_pages(work: Workspace, pages: DataFrame, least_bytes: int = 1000, split_bytes: int = 32 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as archives and return the records as read back.

    Null html is an empty payload; a null page_id or url has no id or URI in the record and
    comes back null. Rows that share the largest page_id of a payload are all responses. An
    empty table writes no file and gives no record.
    """
    listed = work.write(write_archives(plan_revisits(pages, least_bytes), f"{work.folder}/archives"), "listing")
    return read_archives(listed, split_bytes, payloads=False)
