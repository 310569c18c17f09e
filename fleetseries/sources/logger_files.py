"""Logger files (4-line header + quoted CSV body): discovery, header and body scan.

The file listing drives all reads. ``scan_headers`` reads the head of each
listed file and keeps one row per file. Bodies are cut into byte ranges behind
the header, each range carries its file's own column list, and a task reads
the ranges it is given (``byte_ranges``); so columns may drift between files,
no line is joined to its header, and ``row_pos`` is the byte offset of a line.
``ingest`` writes parsed rows and rejected lines in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.functions.scalar import na_to_null, parse_time
from fleetseries.operators.globs import PatternIndex, pattern_family  # noqa: F401
from fleetseries.operators.reconcile import is_archived
from fleetseries.schemas import (
    HISTORICAL_SUFFIX,
    LOGGER_INFO_FIELDS,
    LOGGER_MARKER,
    LOGGER_NA_TOKENS,
    MESSAGES,
)
from fleetseries.session import let, qualified, write_table
from fleetseries.sources.byte_ranges import first_lines, list_folders, read_ranges

#: Bytes of a body range; a task is given four of them, or fewer where that uses more tasks.
RANGE_BYTES = 32 << 20
# A comma and its field: quoted sections and plain runs up to a comma outside quotes; an open
# quote runs to the end of the line. Possessive, so linear in the line.
_CSV_FIELD = r',((?:"[^"]*+(?:"|$)|[^,"]++)*+)'


def csv_fields(line: Column) -> Column:
    """Split one CSV line into its fields (quotes removed, ``""`` unescaped)."""
    text = F.concat(F.lit(","), F.regexp_replace(line, r"\r$", ""))
    parts = F.regexp_extract_all(text, F.lit(_CSV_FIELD), F.lit(1))
    return F.transform(parts, lambda p: F.when(
        F.startswith(p, F.lit('"')), F.replace(F.regexp_replace(p, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(p))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing (file_name, size, modified) without reading content; no empty files, and none that Spark hides.

    A level of folders after the other, each dealt to tasks and written to the shared folder: the driver holds no names.
    """
    folders = spark.range(1).select(F.lit(qualified(spark, root)).alias("file_name"))
    levels = []
    while True:
        level = write_table(list_folders(folders), "listing")
        levels.append(level.where("not is_folder and size > 0").drop("is_folder"))
        folders = level.where("is_folder").select("file_name")
        if not folders.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        folders = folders.repartition(4 * spark.sparkContext.defaultParallelism)


def scan_headers(files: DataFrame) -> DataFrame:
    """One row per listed file (file_name, size): header fields, ``valid`` and the reason if not.

    ``columns``, ``units`` and ``agg_types`` are the file's own; ``body_start`` is the
    offset behind the header, ``bytes_read`` what was read to find it.
    """
    heads = first_lines(files, 4, LOGGER_MARKER)
    n = F.size("lines")
    info = csv_fields(F.col("lines")[0])
    heads = heads.withColumn("_info", F.when(n > 0, info).otherwise(F.array().cast("array<string>")))
    n_info = F.size("_info")
    marker = F.get("_info", 0)
    valid = (n >= 4) & (n_info == LOGGER_INFO_FIELDS) & (marker == LOGGER_MARKER)
    reason = (
        F.when(n < 4, MESSAGES["header_short"])
        .when(n_info != LOGGER_INFO_FIELDS,
              F.format_string(MESSAGES["header_fields"], F.lit(LOGGER_INFO_FIELDS), n_info))
        .when(marker != LOGGER_MARKER, F.concat(F.lit(MESSAGES["header_marker"]), marker))
    )
    names = ["station_name", "logger_model", "serial_no", "os_version", "program_name", "program_sig", "table_name"]
    return heads.select(
        "file_name", "size",
        *[F.when(valid, F.get("_info", i + 1)).alias(nm) for i, nm in enumerate(names)],
        *[F.when(valid, csv_fields(F.get("lines", i + 1))).alias(nm) for i, nm in enumerate(["columns", "units", "agg_types"])],
        "body_start", "bytes_read", F.coalesce(valid, F.lit(False)).alias("valid"), reason.alias("reason"),
    )


def body_ranges(headers: DataFrame, timestamp_column: str = "TIMESTAMP", needed: Sequence[str] | None = None,
                range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_name, start, end) tiles of the bodies of valid files, with the file's columns.

    ``names`` are the kept columns (the first of a repeated name; only ``needed``
    ones if given), ``places`` their positions from 1, ``ts_place`` the time's
    position (0: the file has no such column), ``n_columns`` the header's width.
    """
    # equal names are neighbours once sorted, so a wide header costs no look at all its columns for each of them
    numbered = F.sort_array(F.transform("columns", lambda c, i: F.struct(c.alias("name"), (i + 1).cast("int").alias("place"))))
    first = let(numbered, lambda x: F.filter(x, lambda c, i: (i == 0) | (F.get(x, i - 1)["name"] != c["name"])))
    kept = F.filter(first, lambda c: c["name"] != timestamp_column)
    if needed is not None:
        kept = F.filter(kept, lambda c: c["name"].isin(list(needed)))
    kept = F.sort_array(F.transform(kept, lambda c: F.struct(c["place"].alias("place"), c["name"].alias("name"))))
    h = headers.filter(F.col("valid") & (F.col("size") > F.col("body_start"))).select("*", kept.alias("kept"))
    h = h.select(
        "file_name", "size", "body_start", F.col("kept.name").alias("names"), F.size("columns").alias("n_columns"),
        F.col("kept.place").alias("places"),
        F.array_position("columns", timestamp_column).cast("int").alias("ts_place"),
    )
    starts = F.sequence(F.col("body_start"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    return h.withColumn("start", F.explode(starts)).select(
        "file_name", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"),
        "names", "places", "ts_place", "n_columns")


def scan_body(headers: DataFrame, timestamp_column: str = "TIMESTAMP", needed: Sequence[str] | None = None,
              na_tokens: Sequence[str] = LOGGER_NA_TOKENS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Body lines of valid files, parsed: file_name, block_start (0), row_pos, time, time_text, strict_time,
    cells, short_line, long_line, line.

    ``headers`` should be a written table (it is read for the ranges and for
    their number). A short line lacks its last cells (null), surplus fields of
    a long one are dropped; lines without a readable time have a null ``time``.
    """
    spark = headers.sparkSession
    ranges = body_ranges(headers, timestamp_column, needed, range_bytes)
    total = headers.filter("valid").agg(F.sum("size"), F.count("*")).first()
    tasks = max(1, min(total[1], 4 * spark.sparkContext.defaultParallelism), (total[0] or 0) // (4 * range_bytes))
    pieces = read_ranges(ranges.repartition(tasks, "file_name", "start"))
    lines = pieces.select("file_name", "names", "places", "ts_place", "n_columns", F.inline("lines"))
    lines = lines.filter(F.length(F.trim("line")) > 0).withColumn("_fields", csv_fields(F.col("line")))
    cells = F.map_from_arrays("names", F.transform("places", lambda i: na_to_null(F.get("_fields", i - 1), na_tokens)))
    ts_text = na_to_null(F.get("_fields", F.col("ts_place") - 1), na_tokens)
    return lines.select(
        "file_name", F.lit(0).cast("bigint").alias("block_start"), "row_pos",
        parse_time(ts_text).alias("time"), ts_text.alias("time_text"),
        parse_time(ts_text, []).isNotNull().alias("strict_time"), cells.alias("cells"),
        (F.size("_fields") < F.col("n_columns")).alias("short_line"),
        (F.size("_fields") > F.col("n_columns")).alias("long_line"), "line",
    )


def ingest(headers: DataFrame, path: str, dataset_of: Callable[[Column], Column],
           timestamp_column: str = "TIMESTAMP") -> tuple[DataFrame, DataFrame]:
    """Read and parse all bodies once, write rows and rejects below ``path``, return both as stored tables.

    Rows: dataset_id, file_name, block_start, row_pos, time, strict_time, cells,
    short_line, long_line; every line with a readable time. Rejects: file_name,
    row_pos, reason, kept, line; ``no_time`` lines (not kept), ``short_line`` and
    ``long_line`` (kept as rows), and per file, without a position, a header
    that is none (its reason) or ``repeated_column`` (the first of a name is kept).
    One write, partitioned by kind; each table reads its own part of it.
    """
    spark = headers.sparkSession
    body = scan_body(headers, timestamp_column)
    reasons = F.filter(F.array(
        F.when(F.col("time").isNull(), "no_time"), F.when(F.col("short_line"), "short_line"),
        F.when(F.col("long_line"), "long_line")), lambda r: r.isNotNull())
    kinds = F.concat(F.when(F.col("time").isNotNull(), F.array(F.lit("row"))).otherwise(F.array().cast("array<string>")), reasons)
    tagged = body.withColumn("tag", F.explode(kinds))
    row = F.col("tag") == "row"
    tagged = tagged.select(
        dataset_of(F.col("file_name")).alias("dataset_id"), "file_name", "block_start", "row_pos", "time", "strict_time",
        F.when(row, F.col("cells")).alias("cells"), "short_line", "long_line", F.when(~row, F.col("line")).alias("line"),
        F.when(~row, F.col("tag")).alias("reason"), F.when(row, "row").otherwise("reject").alias("kind"))
    tagged.write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(tagged.schema).parquet(path)
    rows = stored.filter("kind = 'row'").drop("kind", "reason", "line")
    rejects = stored.filter("kind = 'reject'").select(
        "file_name", "row_pos", "reason", (F.col("reason") != "no_time").alias("kept"), "line")
    repeated = F.col("valid") & (F.size(F.array_distinct("columns")) < F.size("columns"))
    files = headers.filter(~F.col("valid") | repeated).select(
        "file_name", F.lit(None).cast("bigint").alias("row_pos"),
        F.when(F.col("valid"), "repeated_column").otherwise(F.col("reason")).alias("reason"),
        "valid", F.lit(None).cast("string").alias("line")).withColumnRenamed("valid", "kept")
    return rows, rejects.unionByName(files)


def file_quality(body: DataFrame) -> DataFrame:
    """Per file: lines, lines parsed only by a fallback timestamp format, rows
    without a parseable time (rejects), short and long lines."""
    return body.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("time").isNotNull() & ~F.col("strict_time")).cast("bigint").alias("n_fallback"),
        F.count_if(F.col("time").isNull()).cast("bigint").alias("n_reject"),
        F.count_if("short_line").cast("bigint").alias("n_short"),
        F.count_if("long_line").cast("bigint").alias("n_long"),
    )


def discover(files: DataFrame, sources: DataFrame, root: str) -> DataFrame:
    """Files of each dataset by its pattern family.

    ``sources``: (dataset_id, file_pattern, historical_suffix), glob patterns
    relative to ``root``. Files meet only the patterns that share their longest
    literal prefix (``globs.PatternIndex``); then the family's regex decides.
    """
    suffix = F.coalesce("historical_suffix", F.lit(HISTORICAL_SUFFIX))
    patterns = sources.select("dataset_id", "file_pattern", suffix.alias("historical_suffix"))
    plain = F.regexp_replace("file_name", r"^file:(//)?(?=/)", "")
    start = F.lit(root.rstrip("/").removeprefix("file://").removeprefix("file:") + "/")
    rel = F.when(F.startswith(plain, start), F.substr(plain, F.length(start) + 1))
    listed = files.withColumn("rel_path", rel).filter("rel_path is not null")
    found = PatternIndex(patterns).match(listed)
    return found.select(
        "dataset_id", "file_name", "rel_path",
        F.when(is_archived(F.col("file_name"), F.col("historical_suffix")), "archived").otherwise("live").alias("file_role"),
        "size", "modified").distinct()
