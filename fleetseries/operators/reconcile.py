"""File roles, ranking, bounds and keep-last de-duplication of raw rows.

All functions are keyed by ``dataset_id``; none triggers a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.functions.scalar import ts_lit
from fleetseries.schemas import BACKUP_EXTENSION_PREFIX, HISTORICAL_SUFFIX


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_archived(file_name: Column, historical_suffix: str | Column = HISTORICAL_SUFFIX) -> Column:
    """Archived: the stem (base name without its last extension) ends with the
    suffix, or any extension of the base name starts with ``.backup``."""
    base = _base_name(file_name)
    stem = F.regexp_extract(base, r"^(.*?)(\.[^.]*)?$", 1)
    suffix = F.lit(historical_suffix) if isinstance(historical_suffix, str) else historical_suffix
    parts = F.split(F.ltrim(base, F.lit(".")), r"\.")
    extensions = F.slice(parts, F.lit(2), F.size(parts))
    has_backup = F.exists(extensions, lambda p: F.startswith(p, F.lit(BACKUP_EXTENSION_PREFIX[1:])))
    return F.endswith(stem, suffix) | has_backup


def classify_roles(files: DataFrame, historical_suffix: str = HISTORICAL_SUFFIX) -> DataFrame:
    """Add ``file_role`` (``live`` / ``archived``) to a file listing."""
    return files.withColumn(
        "file_role",
        F.when(is_archived(F.col("file_name"), historical_suffix), "archived").otherwise("live"),
    )


def role_violations(classified: DataFrame) -> DataFrame:
    """Datasets whose listing does not hold exactly one live file."""
    return (
        classified.groupBy("dataset_id")
        .agg(
            F.count_if(F.col("file_role") == "live").cast("bigint").alias("n_live"),
            F.count(F.lit(1)).alias("n_files"),
        )
        .filter(F.col("n_live") != 1)
    )


def file_bounds(rows: DataFrame) -> DataFrame:
    """Per file: first/last timestamp, row count and sorted column names (map-side partial aggregation:
    a file has few distinct sets of names, so few are gathered)."""
    return rows.groupBy("dataset_id", "file_name").agg(
        F.min("time").alias("time_start"),
        F.max("time").alias("time_end"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sort_array(F.map_keys("cells")))))).alias("variables"),
    )


def rank_files(files: DataFrame) -> DataFrame:
    """``file_rank``: archived files by their own first timestamp (missing first),
    then the live file last; ties keep file-name order.

    The window is per dataset over the file list only (one row per file).
    """
    w = Window.partitionBy("dataset_id").orderBy(
        (F.col("file_role") == "live").asc(),
        F.col("time_start").asc_nulls_first(),
        F.col("file_name").asc(),
    )
    return files.withColumn("file_rank", F.row_number().over(w))


def dedup_keep_last(rows: DataFrame, keys: tuple[str, ...] = ("dataset_id", "time")) -> DataFrame:
    """One row per exact timestamp: the whole row of the later file wins, within
    a file the later line.

    ``row_number() = 1`` plans as a WindowGroupLimit (partial before the
    shuffle, final after), so only one candidate per key and map task moves.
    The key includes ``time``, so one long station spreads over all tasks.
    """
    w = Window.partitionBy(*keys).orderBy(
        F.col("file_rank").desc(), F.col("block_start").desc(), F.col("row_pos").desc()
    )
    return (
        rows.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


def union_files(files: Sequence[DataFrame]) -> DataFrame:
    """Rows of files whose columns differ, under all their columns; a column that a file lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)


def program_changes(headers: DataFrame) -> DataFrame:
    """Filesets whose contributing files carry more than one program name."""
    return (
        headers.groupBy("dataset_id")
        .agg(
            F.count_distinct("program_name").alias("n_programs"),
            F.array_join(F.sort_array(F.collect_set("program_name")), ",").alias("programs"),
        )
        .filter(F.col("n_programs") > 1)
    )


def prune_files(index: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Files whose [time_start, time_end] overlaps the inclusive window.
    Files without bounds (nothing parsed yet) are never selected."""
    cond = F.col("time_start").isNotNull() & F.col("time_end").isNotNull()
    if start is not None:
        cond = cond & (F.col("time_end") >= ts_lit(start))
    if end is not None:
        cond = cond & (F.col("time_start") <= ts_lit(end))
    return index.filter(cond)


def time_window(df: DataFrame, start: datetime | None, end: datetime | None,
                half_open: bool = False, column: str = "time") -> DataFrame:
    """Inclusive ``[start, end]`` filter (``half_open`` gives ``[start, end)``)."""
    c = F.col(column)
    if start is not None:
        df = df.filter(c >= ts_lit(start))
    if end is not None:
        e = ts_lit(end)
        df = df.filter(c < e if half_open else c <= e)
    return df
