"""Byte-range reads of text files, driven by tables of (path, range).

A task gets rows that name a file and a range and reads only those bytes, in
pieces, so neither a file nor a range has to fit in memory. Files are opened
through ``pyarrow.fs`` (local disks and the object stores it knows); paths are
the plain ones of a file listing, blanks included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_BYTES = 64 << 10   # first read of a file's head; doubled while the head goes on
LISTED = 10_000         # names of a folder given on at once
PIECE_BYTES = 1 << 20   # bytes of a range held at once (a longer line is held whole)

LINES = T.ArrayType(T.StructType([T.StructField("row_pos", T.LongType()), T.StructField("line", T.StringType())]))


@lru_cache(maxsize=16)
def _file_system(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of a listing, and the path within it."""
    if not re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path) or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)
    scheme, rest = path.split("://", 1)
    host, _, key = rest.partition("/")
    store = _file_system(f"{scheme}://{quote(host, safe='@:')}/")
    return store, f"{host}/{key}" if scheme in ("s3", "gs", "gcs") else f"/{key}"


def _hidden(name: str) -> bool:
    """Names that Spark's own listings leave out."""
    inner = name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))
    return inner or name.endswith("._COPYING_")


def list_folders(folders: DataFrame) -> DataFrame:
    """file_name, size, modified, is_folder of what each listed folder (file_name) holds directly."""
    kinds = pa.schema([("file_name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])

    def listed(folder: str, found: list[fs.FileInfo]) -> Iterator[tuple]:
        for f in found:
            # whole milliseconds, as in Spark's listings
            modified = None if f.mtime_ns is None else f.mtime_ns // 10**6 * 1000
            yield f"{folder.rstrip('/')}/{f.base_name}", f.size, modified, f.type == fs.FileType.Directory

    def tables(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), LISTED):
            yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*rows[k:k + LISTED]))), schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column("file_name").to_pylist():
                store, inner = resolve(folder)
                rows += listed(folder, [f for f in store.get_file_info(fs.FileSelector(inner)) if not _hidden(f.base_name)])
                if len(rows) >= LISTED:
                    yield from tables(rows)
                    rows = []
            yield from tables(rows)

    return folders.mapInArrow(run, "file_name string, size long, modified timestamp, is_folder boolean")


def open_input(path: str) -> pa.NativeFile:
    """A file of a listing, open for random reads."""
    store, inner = resolve(path)
    return store.open_input_file(inner)


def _head(path: str, n: int, expected: bytes) -> tuple[list[bytes], int, int]:
    """The first ``n`` lines, the offset behind them, and the bytes read."""
    with open_input(path) as f:
        data, step = f.read(HEAD_BYTES), HEAD_BYTES
        more = len(data) == step
        while more and data.count(b"\n") < n and expected in data[:64]:
            chunk = f.read(step)
            more, step = len(chunk) == step, 2 * step
            data += chunk
    lines, at = [], 0
    while len(lines) < n and at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        lines.append(data[at:end])
        at = end + 1
    return lines, min(at, len(data)), len(data)


def first_lines(files: DataFrame, n: int, expected: str) -> DataFrame:
    """file_name, size, lines, body_start, bytes_read of every listed file.

    Only the head is read: a first piece, and further ones only while a file
    that starts like ``expected`` has not shown ``n`` lines yet.
    """
    marker = expected.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [_head(p, n, marker) for p in batch.column("file_name").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "file_name": batch.column("file_name"), "size": batch.column("size"),
                "lines": pa.array([[x.decode("utf-8", "replace") for x in h[0]] for h in heads], pa.list_(pa.string())),
                "body_start": pa.array([h[1] for h in heads], pa.int64()),
                "bytes_read": pa.array([h[2] for h in heads], pa.int64()),
            })

    return files.select("file_name", F.col("size").cast("long").alias("size")).mapInArrow(
        run, "file_name string, size long, lines array<string>, body_start long, bytes_read long")


def read_whole(files: DataFrame) -> DataFrame:
    """file_name and content (bytes) of every listed file; a task holds about ``PIECE_BYTES`` of files, or one longer file."""
    kinds = pa.schema([("file_name", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents, size = [], [], 0
            for path in batch.column("file_name").to_pylist():
                with open_input(path) as f:
                    data = f.read()
                if names and size + len(data) > PIECE_BYTES:
                    yield pa.RecordBatch.from_pydict({"file_name": names, "content": contents}, schema=kinds)
                    names, contents, size = [], [], 0
                names.append(path)
                contents.append(data)
                size += len(data)
            if names:
                yield pa.RecordBatch.from_pydict({"file_name": names, "content": contents}, schema=kinds)

    return files.select("file_name").mapInArrow(run, "file_name string, content binary")


def _pieces(path: str, start: int, end: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Offsets and texts of the lines whose first byte lies in [start, end), piece by piece."""
    with open_input(path) as f:
        at = max(start - 1, 0)
        f.seek(at)
        rest = b""
        inside = start == 0  # a range starts behind a line end, or skips to the next one
        while True:
            chunk = f.read(PIECE_BYTES)
            rest += chunk
            if not inside:
                cut = rest.find(b"\n")
                if cut < 0 and chunk and at + len(rest) < end:
                    at, rest = at + len(rest), b""
                    continue
                if cut < 0 or at + cut + 1 >= end:
                    return
                rest, at, inside = rest[cut + 1:], at + cut + 1, True
            last = len(rest) if not chunk else rest.rfind(b"\n") + 1
            block, rest = rest[:last], rest[last:]
            if block:
                text = block[:-1] if block.endswith(b"\n") else block
                raw = text.split(b"\n")
                pos = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw[:-1]], dtype=np.int64)])
                own = int(np.searchsorted(pos, end))
                yield pos[:own], text.decode("utf-8", "replace").split("\n")[:own]
                at += last
            if not chunk or at >= end:
                return


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges`` (file_name, start, end, other columns) with its lines: an array of (row_pos, line) per piece.

    ``row_pos`` is the byte offset of a line in its file. A line belongs to the
    range that holds its first byte, so ranges that tile a file give each line once.
    """
    kept = [f for f in ranges.schema.fields if f.name not in ("start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, start, end = (batch.column(c)[i].as_py() for c in ("file_name", "start", "end"))
                row = {f.name: batch.column(f.name).slice(i, 1) for f in kept}
                for pos, lines in _pieces(path, start, end):
                    struct = pa.StructArray.from_arrays([pa.array(pos), pa.array(lines, pa.string())], ["row_pos", "line"])
                    out = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), struct)
                    yield pa.RecordBatch.from_pydict({**row, "lines": out})

    return ranges.mapInArrow(run, T.StructType([*kept, T.StructField("lines", LINES)]))
