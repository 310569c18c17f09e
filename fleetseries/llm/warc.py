"""WARC archives: a writer, and a splittable reader.

Writer: payload digests meet the smallest page id per digest (narrow rows,
summed before the shuffle); each task then writes its records, one gzip member
each, as one archive file in the shared folder. A file is written under a name
of its own and counts only when the task that wrote it is the one whose
manifest row Spark commits, so lost executors and repeated tasks leave no
duplicates.

Reader: the files of the manifest are cut into byte ranges; a task scans its
range for the gzip magic, accepts a candidate only if it inflates to a WARC
header and the member ends where its headers say, and owns the records that
start inside the range, reading past its end where needed. Files are opened
with ``pyarrow.fs``, by URI, on whichever store the shared folder is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.session import new_scratch_path

from .common import small_batches, table
from .queries import query

SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
#: What is read at a time beyond a range, and inflated at a time.
STEP = 256 << 10
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, bytes long, records long, starts array<long>"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":/" in path else f"file://{path}")


def _uri(url: str | None, page: int | None) -> bytes:
    safe = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return (safe or f"urn:page:{page}").encode()


def _record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = _HTTP % len(payload)
    block = head if revisit else head + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid4()).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + _uri(url, page),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest),
        b"Content-Type: application/http; msgtype=response",
        b"X-Payload-Length: %d" % len(payload),
        *([b"X-Page-Id: %d" % page] if page is not None else []),
        *([b"WARC-Profile: " + _REVISIT.encode()] if revisit else []),
        *([b"X-Refers-To-Page-Id: %d" % refers_to] if revisit and refers_to is not None else []),
        b"Content-Length: %d" % len(block),
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        fs, path = _open(name)
        out, size, starts = None, 0, []
        for batch in batches:
            payloads = batch.column("html").cast(pa.binary()).to_pylist()
            pages, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            digests, first = batch.column("digest").to_pylist(), batch.column("refers_to").to_pylist()
            for page, url, payload, digest, origin, revisit in zip(
                pages, urls, payloads, digests, first, batch.column("revisit").to_pylist()
            ):
                if out is None:
                    fs.create_dir(path.rpartition("/")[0])
                    out = fs.open_output_stream(path, compression=None)
                data = _record(page, url, payload or b"", digest, origin, revisit)
                out.write(data)
                starts.append(size)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [len(starts)], "starts": [starts]})

    return run


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); return the manifest (path, bytes, records, starts: their offsets).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest page_id is a response and the others revisit it. Rows
    that share that smallest id are all responses; rows without an id are
    revisits where some row has one, else responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_scratch_path(spark, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    first = (
        rows.where(F.length("html") >= min_revisit_bytes)
        .groupBy(F.col("digest").alias("first_digest"))
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # the page side is the one that may be skewed (many equal payloads): a join that AQE can split
    marked = rows.join(first, rows["digest"] == first["first_digest"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    marked = marked.select("page_id", "url", "html", "digest", "refers_to", revisit.alias("revisit"))
    manifest = f"{folder}/manifest"
    marked.mapInArrow(_writer(f"{folder}/data"), _MANIFEST).write.parquet(manifest)
    return spark.read.parquet(manifest)


class _Window:
    """A file read forward from some offset, a step at a time."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""

    def upto(self, end: int) -> None:
        """Have the bytes up to offset ``end`` (or the end of the file) at hand."""
        have = self.at + len(self.data)
        if have < min(end, self.size):
            self.file.seek(have)
            self.data += self.file.read(min(max(end - have, STEP), self.size - have))

    def drop(self, before: int) -> None:
        if before - self.at >= 4 * STEP:
            self.data, self.at = self.data[before - self.at :], before


def _inflate(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The member that starts at ``start`` and the offset after it; None unless it is a whole WARC record."""
    z = zlib.decompressobj(31)
    out, at = [], start
    total, checked = 0, False
    while not z.eof:
        window.upto(at + STEP)
        chunk = window.data[at - window.at : at - window.at + STEP]
        if not chunk:
            return None
        try:
            piece = z.decompress(chunk)
        except zlib.error:
            return None
        out.append(piece)
        total += len(piece)
        at += len(chunk) - len(z.unused_data)
        if not checked and total >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
    data = b"".join(out)
    end = data.find(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: *(\d+)(?:\r\n|$)", data[:end]) if end >= 0 and checked else None
    return (data, at) if size and len(data) == end + 4 + int(size[1]) + 4 else None


def records(path: str, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record whose member starts in ``start <= offset < end`` of a file of ``size`` bytes."""
    fs, name = _open(path)
    with fs.open_input_file(name) as file:
        window = _Window(file, start, size)
        at = start
        while at < end:
            window.drop(at)
            window.upto(at + STEP)
            found = window.data.find(MAGIC, at - window.at)
            if found < 0:
                have = window.at + len(window.data)
                at = max(at + 1, have - len(MAGIC) + 1)
                if have >= size:
                    return
                continue
            at = window.at + found
            if at >= end:
                return
            member = _inflate(window, at)
            if member is None:
                at += 1
                continue
            data, at = member
            head, _, block = data[:-4].partition(b"\r\n\r\n")
            fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
            yield {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in fields}, block


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    for batch in batches:
        for part in batch.to_pylist():
            rows, held, found = [], 0, 0
            for fields, block in records(part["path"], part["start"], part["end"], part["bytes"]):
                found += 1
                payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                n = int(fields["x-payload-length"])
                if payload is not None:
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (own, len(payload)) != (digest, n):
                        raise ValueError(f"{part['path']}: payload does not match its digest")
                page, origin = (int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id"))
                rows.append((page, fields["warc-target-uri"], n, digest, fields["warc-type"], origin, payload))
                held += len(payload or b"")
                if held > 4 << 20:
                    yield _rows(rows, names)
                    rows, held = [], 0
            if found != part["records"]:
                raise ValueError(f"{part['path']}: {found} records from {part['start']} to {part['end']}, the manifest has {part['records']}")
            if rows:
                yield _rows(rows, names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _without_payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _reader(batches):
        yield batch.drop_columns(["payload"])


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest`` (path, bytes, starts).

    Columns page_id, url, payload_bytes, payload_digest (base32 SHA-1, checked
    against the payload of responses), record_type, refers_to, and with
    ``payloads`` the payload (null for revisits). A range that holds more or
    fewer records than the manifest has for it is an error.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = manifest.select("path", "bytes", "starts", F.explode(starts).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    own = F.filter("starts", lambda at: (at >= F.col("start")) & (at < F.col("end")))
    splits = splits.withColumn("records", F.size(own)).drop("starts")
    n = max(1, splits.count())
    dealt = splits.repartitionByRange(min(n, 10_000), "path", "start")
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
    if payloads:
        return dealt.mapInArrow(_reader, schema + ", payload binary")
    return dealt.mapInArrow(_without_payload, schema)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, CAST(i + 1 AS BIGINT), 1)) - 1) AS h FROM p),
m AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + list_sum(list_transform(range(5), lambda j: ((h[CAST(1 + (5 * k + j) // 4 AS BIGINT)] >> CAST(3 - (5 * k + j) % 4 AS INTEGER)) & 1)
                                          << CAST(4 - j AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN m USING (hex)
"""


@query("op1_warc", ORACLE)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
