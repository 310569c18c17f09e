"""Text files under given names, written by the tasks that hold their lines."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetseries.session import write_table
from fleetseries.sources.byte_ranges import resolve


def write_files(lines: DataFrame, root: str) -> DataFrame:
    """Write (path, line) rows as files below ``root``; returns the written list (path, n_lines, n_bytes).

    The rows of a path must be adjacent, in order, in one partition. A file is
    written beside its place and moved there when complete, so a retried task
    replaces it and readers never see half of one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = resolve(root)
        path, out, temp, n_lines, n_bytes = None, None, None, 0, 0
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            out.close()
            store.move(temp, posixpath.join(base, path))
            done.append((path, n_lines, n_bytes))

        def written() -> pa.RecordBatch:
            paths, lines_, bytes_ = ([row[k] for row in done] for k in range(3))
            done.clear()
            return pa.RecordBatch.from_pydict({"path": paths, "n_lines": lines_, "n_bytes": bytes_})

        for batch in batches:
            for name, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                if name != path:
                    if out is not None:
                        finish()
                    path, n_lines, n_bytes = name, 0, 0
                    folder = posixpath.dirname(posixpath.join(base, path))
                    store.create_dir(folder, recursive=True)
                    temp = posixpath.join(folder, f"_{uuid.uuid4().hex}")
                    out = store.open_output_stream(temp)
                data = line.encode() + b"\n"
                out.write(data)
                n_lines, n_bytes = n_lines + 1, n_bytes + len(data)
            if done:
                yield written()
        if out is not None:
            finish()
            yield written()

    return write_table(lines.select("path", "line").mapInArrow(run, "path string, n_lines long, n_bytes long"), "written-files")
