"""Flat CSV source: a header line, a named timestamp column, one file per dataset.

Every file has columns of its own. Headers are read from the heads of the
listed files and bodies by byte ranges, as for logger files; cells are a map,
all text (no schema inference). Duplicates are kept, as the source does not
de-duplicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.schemas import FLAT_CSV_NA_TOKENS
from fleetseries.sources import logger_files as lf
from fleetseries.sources.byte_ranges import first_lines


def scan_headers(files: DataFrame, timestamp_column: str = "timestamp") -> DataFrame:
    """One row per listed file (file_name, size): its columns, whether it has the timestamp column, the reason if not.

    A repeated name gets its number appended (``x``, ``x.1``), so no column hides another.
    """
    heads = first_lines(files, 1, "")
    names = lf.csv_fields(F.regexp_replace(F.get("lines", 0), "^﻿", ""))
    heads = heads.withColumn("names", F.when(F.size("lines") > 0, names).otherwise(F.array().cast("array<string>")))

    def numbered(c, i):
        before = F.size(F.filter(F.slice("names", F.lit(1), i), lambda x: x == c))
        return F.when(before > 0, F.concat(c, F.lit("."), before.cast("string"))).otherwise(c)

    valid = F.array_contains("names", timestamp_column)
    return heads.select(
        "file_name", "size", "body_start", F.transform("names", numbered).alias("columns"), valid.alias("valid"),
        F.when(~valid, F.lit(f"no column {timestamp_column}")).alias("reason"))


def scan_flat_csv(headers: DataFrame, timestamp_column: str = "timestamp", columns: Sequence[str] | None = None) -> DataFrame:
    """Body rows (file_name, row_pos, time, cells, short_line, long_line) of the files with a timestamp column.

    ``columns`` prunes cells to the needed names. Rows without a readable time have a null ``time``.
    """
    body = lf.scan_body(headers, timestamp_column, columns, FLAT_CSV_NA_TOKENS)
    return body.select("file_name", "row_pos", "time", "cells", "short_line", "long_line")
