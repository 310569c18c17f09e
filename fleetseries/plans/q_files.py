"""File-level queries: roles, bounds, ranks, dedup, drift, index refresh, logger files."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fleetseries.operators import coverage as cov
from fleetseries.operators import index as idx
from fleetseries.operators import reconcile as rec
from fleetseries.operators import rules
from fleetseries.plans import fixtures as fx
from fleetseries.plans.build import build_dataset, file_ranks, ranked_rows
from fleetseries.plans.registry import register
from fleetseries.schemas import FILE_INDEX
from fleetseries.session import new_scratch_path, path_exists, scratch_path, write_table
from fleetseries.sources import flat_csv
from fleetseries.sources import logger_files as lf
from fleetseries.sources.named_files import write_files
from fleetseries.sources.state import StateTable, update_index


@register("file_roles", f"""WITH {fx.RAW_SQL}
SELECT DISTINCT dataset_id, file_name, file_role FROM raw""")
def file_roles(spark, d):
    files = fx.raw_rows(spark, d).select("dataset_id", "file_name").distinct()
    return rec.classify_roles(files)


TWO_LIVE_MOD, NO_LIVE_MOD = 17, 19   # stations with a second live file, and without any


@register("role_violations", f"""WITH {fx.RAW_SQL},
files AS (SELECT DISTINCT dataset_id, user_id, file_name, file_role FROM raw WHERE NOT (file_role = 'live' AND user_id % {NO_LIVE_MOD} = 0)
          UNION ALL SELECT DISTINCT dataset_id, user_id, 'st' || user_id || '_Min10.dat', 'live' FROM raw WHERE user_id % {TWO_LIVE_MOD} = 0)
SELECT dataset_id, count(*) FILTER (WHERE file_role = 'live') AS n_live, count(*) AS n_files
FROM files GROUP BY dataset_id HAVING count(*) FILTER (WHERE file_role = 'live') <> 1""")
def role_violations(spark, d):
    files = fx.raw_rows(spark, d).select("dataset_id", "user_id", "file_name").distinct()
    u = F.col("user_id")
    second = files.filter(u % TWO_LIVE_MOD == 0).select("dataset_id", "user_id", F.concat(F.col("dataset_id"), F.lit("_Min10.dat"))
                                                        .alias("file_name")).distinct()
    kept = files.filter(~(F.col("file_name").endswith("_Min.dat") & (u % NO_LIVE_MOD == 0)))
    return rec.role_violations(rec.classify_roles(kept.unionByName(second)))


@register("file_bounds", f"""WITH {fx.RAW_SQL}
SELECT dataset_id, file_name, min(time) AS time_start, max(time) AS time_end, count(*) AS n_rows,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS variables
FROM raw GROUP BY dataset_id, file_name""")
def file_bounds(spark, d):
    return rec.file_bounds(fx.raw_rows(spark, d)).withColumn("variables", F.array_join("variables", ","))


@register("file_rank", f"""WITH {fx.FILES_SQL}
SELECT dataset_id, file_name, file_role, time_start, file_rank FROM ranked""")
def file_rank(spark, d):
    roles = rec.classify_roles(rec.file_bounds(fx.raw_rows(spark, d)))
    return rec.rank_files(roles).select("dataset_id", "file_name", "file_role", "time_start", "file_rank")


@register("reconcile_dedup", f"""WITH {fx.DEDUP_SQL}
SELECT dataset_id, time, file_name, file_rank, row_pos, event_type AS raw_name, value FROM dedup""")
def reconcile_dedup(spark, d):
    raw = fx.raw_rows(spark, d)
    out = rec.dedup_keep_last(ranked_rows(raw, file_ranks(raw)))
    return out.select("dataset_id", "time", "file_name", "file_rank", "row_pos",
                      F.col("event_type").alias("raw_name"), "value")


def _typed(c: str):
    return F.when(F.col("event_type") == c, F.col("value"))


@register("fileset_union", f"""WITH {fx.RAW_SQL}
SELECT dataset_id, file_name, row_pos, time,
  {", ".join(f"CASE WHEN event_type = '{c}' THEN value END AS {c}" for c in fx.EVENT_TYPES)},
  CASE WHEN file_role = 'live' THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) END AS k
FROM raw JOIN (SELECT event_id, props FROM events) e USING (event_id)""")
def fileset_union(spark, d):
    raw = fx.raw_rows(spark, d)
    live = F.col("file_name").endswith("_Min.dat")
    base = ["dataset_id", "file_name", "row_pos", "time"]
    archived = raw.filter(~live).select(*base, *[_typed(c).alias(c) for c in fx.EVENT_TYPES])
    current = raw.filter(live).select(*base, *[_typed(c).alias(c) for c in fx.EVENT_TYPES],
                                      F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return rec.union_files([archived, current])


def _program_sql() -> str:
    return "'prog_' || CASE WHEN user_id % 5 = 0 AND file_role = 'live' THEN 'v2' ELSE 'v1' END"


@register("program_change", f"""WITH {fx.RAW_SQL}
SELECT dataset_id, count(DISTINCT prog) AS n_programs, string_agg(DISTINCT prog, ',' ORDER BY prog) AS programs
FROM (SELECT dataset_id, {_program_sql()} AS prog FROM raw) GROUP BY dataset_id
HAVING count(DISTINCT prog) > 1""")
def program_change(spark, d):
    raw = fx.raw_rows(spark, d)
    live = F.col("file_name").endswith("_Min.dat")
    headers = raw.select("dataset_id", "file_name", F.concat(
        F.lit("prog_"), F.when((F.col("user_id") % 5 == 0) & live, "v2").otherwise("v1")).alias("program_name")
    ).distinct()
    return rec.program_changes(headers)


PRUNE_T0, PRUNE_T1 = "1997-03-15 00:00:00", "1998-06-30 00:00:00"


@register("file_prune", f"""WITH {fx.lineitem_files_sql('files')}
SELECT dataset_id, file_name, time_start, time_end FROM files
WHERE time_end >= TIMESTAMP '{PRUNE_T0}' AND time_start <= TIMESTAMP '{PRUNE_T1}'""")
def file_prune(spark, d):
    out = rec.prune_files(fx.lineitem_files(spark, d), PRUNE_T0, PRUNE_T1)
    return out.select("dataset_id", "file_name", "time_start", "time_end")


@register("time_coverage", f"""WITH {fx.lineitem_files_sql('files')}
SELECT dataset_id, min(time_start) AS data_start, max(time_end) AS data_end FROM files GROUP BY dataset_id""")
def time_coverage(spark, d):
    return cov.time_coverage(fx.lineitem_files(spark, d))


BEFORE = "2001-06-01 00:00:00"
_ACTIONS_SQL = f"""{fx.index_listing_sql('listing')}, {fx.previous_index_sql(BEFORE)},
act AS (
  SELECT l.*, p.size AS prev_size, p.status AS prev_status, p.time_start AS prev_start, p.time_end AS prev_end,
    CASE WHEN l.file_role = 'archived' AND p.status = 'closed' THEN 'reuse'
         WHEN l.file_role = 'archived' THEN 'parse'
         WHEN p.size IS NULL OR p.size <> l.size THEN 'parse'
         WHEN p.status = 'active' THEN 'close' ELSE 'reuse' END AS action
  FROM listing l LEFT JOIN prev p USING (dataset_id, file_name)),
act2 AS (SELECT *, CASE WHEN file_role = 'archived' THEN 'closed' WHEN action = 'parse' THEN 'active'
                    ELSE 'closed' END AS status FROM act)"""


def _actions(spark, d):
    """Listing of three source types with their change tokens, the stored index, and what to do."""
    listing = idx.with_change_token(fx.index_listing(spark, d))
    prev = fx.previous_index(spark, d, BEFORE)
    return listing, prev, idx.refresh_actions(listing, prev)


@register("index_refresh", f"""WITH {_ACTIONS_SQL}
SELECT dataset_id, file_name, file_role, action, status FROM act2""")
def index_refresh(spark, d):
    _, _, act = _actions(spark, d)
    return act.select("dataset_id", "file_name", "file_role", "action", "status")


@register("index_summary", f"""WITH {_ACTIONS_SQL}
SELECT dataset_id, count(*) AS n_matched, count(*) FILTER (WHERE action = 'parse') AS n_parsed,
       count(*) FILTER (WHERE action <> 'parse') AS n_reused
FROM act2 GROUP BY dataset_id""")
def index_summary(spark, d):
    _, _, act = _actions(spark, d)
    return idx.refresh_summary(act)


@register("index_merge", f"""WITH {_ACTIONS_SQL},
upd AS (SELECT dataset_id, file_name, file_role, size,
          CASE WHEN action = 'parse' THEN time_start ELSE prev_start END AS time_start,
          CASE WHEN action = 'parse' THEN time_end ELSE prev_end END AS time_end, status FROM act2)
SELECT * FROM upd
UNION ALL
SELECT p.dataset_id, p.file_name, p.file_role, p.size, p.time_start, p.time_end, p.status
FROM prev p ANTI JOIN upd u USING (dataset_id, file_name)""")
def index_merge(spark, d):
    # listing and stored index are read again by each step; their files are small for their rows, so the joins merge
    listing = write_table(idx.with_change_token(fx.index_listing(spark, d)), "index_listing").hint("merge")
    index = StateTable(spark, new_scratch_path(spark, "file_index"), FILE_INDEX)
    stored = index.replace(fx.previous_index(spark, d, BEFORE), 0)
    act = idx.refresh_actions(listing, index.read(stored).hint("merge"))
    merged = index.read(update_index(index, idx.refreshed_index(act, listing), stored))
    return merged.select("dataset_id", "file_name", "file_role", "size", "time_start", "time_end", "status")


# ---------------------------------------------------------------------------
# logger files written from events (fixture in the shared folder)

LOGGER_COLUMNS = ["TIMESTAMP", "RECORD", *fx.EVENT_TYPES]
FALLBACK_MOD = 97
# faults written into the logger files, by event or station (configuration of the fixture)
UNDATED_MOD = 101      # an extra line whose time is no time
SHORT_MOD = 103        # a live line that ends before its last column
LONG_MOD = 107         # a live line with a surplus field
REPEAT_MOD = 11        # stations whose live header repeats a name
WIDE_MOD, WIDE_COLUMNS = 50, 3000   # stations whose live file has that many further columns
BLANK_MOD = 13         # stations whose folder name has a blank


def _q(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def station_folder(dataset_id, user_id):
    return F.when(user_id % BLANK_MOD == 0, F.concat(dataset_id, F.lit(" north"))).otherwise(dataset_id)


def station_of(file_name):
    return F.regexp_extract(file_name, r"/(st\d+)[^/]*/[^/]+$", 1)


def fixture_root(spark: SparkSession, name: str, d: str) -> str:
    """Folder of a written fixture: one per input path, whatever its last segment."""
    return scratch_path(spark, name, hashlib.sha256(d.rstrip("/").encode()).hexdigest()[:16])


def write_logger_fixture(spark: SparkSession, d: str) -> str:
    """One logger file per (station, file) from events, plus one stray text
    file per 7th station matching the backup pattern. Written once per input
    folder below the shared folder."""
    root = fixture_root(spark, "logger_fixture", d)
    if path_exists(spark, root + "/_READY"):
        return root
    raw = fx.raw_rows(spark, d)
    live = F.col("file_name").endswith("_Min.dat")
    cols = [*fx.EVENT_TYPES]
    repeats = F.when(F.col("user_id") % REPEAT_MOD == 0, F.lit(1)).otherwise(F.lit(0))
    extra = F.when(F.col("user_id") % WIDE_MOD == 0, F.lit(WIDE_COLUMNS)).otherwise(F.lit(0))
    # every 97th reading is logged in the US date format (parsed by the fallback)
    stamp = F.when(F.col("event_id") % FALLBACK_MOD == 0, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    values = [F.col("event_id").cast("string")] + [
        F.when(F.col("event_type") == c, F.col("value").cast("string")).otherwise(F.lit('"NAN"')) for c in cols]
    tail = F.when(live, F.concat(F.lit(","), F.get_json_object("props", "$.k"), F.repeat(F.lit(",999"), repeats),
                                 F.repeat(F.lit(',"NAN"'), extra))).otherwise(F.lit(""))
    whole = F.concat(F.concat_ws(",", *values), tail)
    line = F.when(live & (F.col("event_id") % SHORT_MOD == 0), F.concat_ws(",", *values)).when(
        live & (F.col("event_id") % LONG_MOD == 0), F.concat(whole, F.when((repeats == 0) & (extra == 0), F.lit(',"surplus, field"'))
                                                            .otherwise(F.lit(",0")))).otherwise(whole)
    entries = F.array(F.concat(_q(stamp), F.lit(","), line))
    undated = F.array(F.concat(F.lit('"not a time",'), whole))
    entries = F.when(F.col("event_id") % UNDATED_MOD == 0, F.concat(entries, undated)).otherwise(entries)
    body = raw.select("user_id", "dataset_id", "file_name", F.col("event_id").alias("seq"),
                      F.posexplode(entries).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 10)
    files = raw.select("dataset_id", "file_name", "user_id").distinct()
    is_live = F.col("file_name").endswith("_Min.dat")
    prog = F.concat(F.lit("prog_"), F.when((F.col("user_id") % 5 == 0) & is_live, "v2").otherwise("v1"))
    wide_names = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WIDE_COLUMNS)), lambda i: F.format_string(',"x%d"', i)), "")
    names = F.when(is_live, F.concat(
        F.lit(",".join(f'"{c}"' for c in [*LOGGER_COLUMNS, "k"])), F.repeat(F.lit(f',"{cols[0]}"'), repeats),
        F.when(extra > 0, wide_names).otherwise(F.lit("")))).otherwise(F.lit(",".join(f'"{c}"' for c in LOGGER_COLUMNS)))
    n_data = F.when(is_live, F.lit(len(cols) + 1) + repeats + extra).otherwise(F.lit(len(cols)))
    info = F.concat_ws(",", _q(F.lit("TOA5")), _q(F.col("dataset_id")), _q(F.lit("CR1000X")), _q(F.lit("1234")),
                       _q(F.lit("CR1000X.Std.05")), _q(prog), _q(F.lit("4711")), _q(F.lit("Min")))
    units = F.concat(F.lit('"TS","RN"'), F.repeat(F.lit(',"degC"'), n_data))
    aggs = F.concat(F.lit('"",""'), F.repeat(F.lit(',"Avg"'), n_data))

    def own_lines(df, lines):
        return df.select("user_id", "dataset_id", "file_name", F.lit(0).cast("bigint").alias("seq"),
                         F.posexplode(lines).alias("line_no", "line"))

    stray_src = files.filter((F.col("user_id") % 7 == 0) & is_live).withColumn(
        "file_name", F.concat(F.col("file_name"), F.lit(".backup9")))
    stray = own_lines(stray_src, F.array(F.lit("this is not a logger file"), F.lit("just notes")))
    lines = own_lines(files, F.array(info, names, units, aggs)).unionByName(body).unionByName(stray)
    first = F.when(F.col("line_no") < 10, F.col("line_no")).otherwise(F.lit(10))
    lines = lines.withColumn("path", F.concat(station_folder(F.col("dataset_id"), F.col("user_id")), F.lit("/"), F.col("file_name")))
    write_files(lines.withColumn("first", first).repartition("path").sortWithinPartitions("path", "first", "seq", "line_no"), root)
    spark.range(1).write.mode("overwrite").parquet(root + "/_READY")
    return root


def logger_files(spark, d):
    """The fixture's folder and its listing: logger files and strays."""
    root = write_logger_fixture(spark, d)
    return root, lf.list_files(spark, root).filter(F.contains(F.col("file_name"), F.lit("_Min")))


def logger_headers(spark, d):
    return write_table(lf.scan_headers(logger_files(spark, d)[1]), "file_headers")


def ingested(spark, d):
    """Rows and rejects of all bodies, from one pass."""
    return lf.ingest(logger_headers(spark, d), new_scratch_path(spark, "bronze"), station_of)


def _base(col):
    return F.regexp_extract(col, r"([^/]*)$", 1)


@register("header_scan", f"""WITH {fx.RAW_SQL}
SELECT DISTINCT file_name, dataset_id AS station_name,
  'prog_' || CASE WHEN user_id % 5 = 0 AND file_role = 'live' THEN 'v2' ELSE 'v1' END AS program_name,
  'Min' AS table_name,
  CAST(CASE WHEN file_role = 'live' THEN 8 + CASE WHEN user_id % {REPEAT_MOD} = 0 THEN 1 ELSE 0 END
    + CASE WHEN user_id % {WIDE_MOD} = 0 THEN {WIDE_COLUMNS} ELSE 0 END ELSE 7 END AS INTEGER) AS n_columns
FROM raw""")
def header_scan(spark, d):
    headers = lf.scan_headers(logger_files(spark, d)[1])
    return headers.filter("valid").select(
        _base(F.col("file_name")).alias("file_name"), "station_name", "program_name", "table_name",
        F.size("columns").alias("n_columns"))


_FILE_SQL = ("'st' || user_id || CASE event_id % 3 WHEN 2 THEN '_Min.dat' WHEN 1 THEN '_Min_Historical.dat' "
             "ELSE '_Min.dat.backup' END")
_SHORT_SQL = f"(event_id % 3 = 2 AND event_id % {SHORT_MOD} = 0)"
_LONG_SQL = f"(event_id % 3 = 2 AND event_id % {LONG_MOD} = 0 AND event_id % {SHORT_MOD} <> 0)"


@register("logger_scan", f"""SELECT {_FILE_SQL} AS file_name,
  date_trunc('second', ts) AS time, event_id AS record,
  {", ".join(f"CASE WHEN event_type = '{c}' THEN value END AS {c}" for c in fx.EVENT_TYPES)},
  CASE WHEN event_id % 3 = 2 AND NOT {_SHORT_SQL} THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
FROM events""")
def logger_scan(spark, d):
    body = lf.scan_body(logger_headers(spark, d), needed=[*LOGGER_COLUMNS, "k"]).filter("time is not null")
    c = F.col("cells")
    return body.select(
        _base(F.col("file_name")).alias("file_name"), "time",
        c["RECORD"].cast("bigint").alias("record"),
        *[c[x].cast("double").alias(x) for x in fx.EVENT_TYPES],
        c["k"].cast("bigint").alias("k"),
    )


@register("logger_rejects", f"""SELECT {_FILE_SQL} AS file_name, event_id AS record, 'no_time' AS reason, false AS kept
FROM events WHERE event_id % {UNDATED_MOD} = 0
UNION ALL SELECT {_FILE_SQL}, event_id, 'short_line', true FROM events WHERE {_SHORT_SQL}
UNION ALL SELECT {_FILE_SQL}, event_id, 'long_line', true FROM events WHERE {_LONG_SQL}
UNION ALL SELECT DISTINCT 'st' || user_id || '_Min.dat', NULL, 'repeated_column', true
FROM events WHERE event_id % 3 = 2 AND user_id % {REPEAT_MOD} = 0
UNION ALL SELECT DISTINCT 'st' || user_id || '_Min.dat.backup9', NULL, 'fewer than 4 header rows', false
FROM events WHERE event_id % 3 = 2 AND user_id % 7 = 0""")
def logger_rejects(spark, d):
    _, rejects = ingested(spark, d)
    return rejects.select(_base(F.col("file_name")).alias("file_name"),
                          F.get(lf.csv_fields(F.col("line")), 1).cast("bigint").alias("record"), "reason", "kept")


def patterns(spark, d):
    """A pattern per station: its folder by name (with a blank in some), by wildcard or by class, or any folder;
    a class or a negated class in some file names."""
    st = fx.raw_rows(spark, d).select("dataset_id", "user_id").distinct()
    u, ds = F.col("user_id"), F.col("dataset_id")
    folder = (F.when(u % 4 == 0, station_folder(ds, u)).when(u % 4 == 1, F.lit("*"))
              .when(u % 4 == 2, F.concat(F.lit("s[a-z]"), F.substring(ds, 3, 20), F.lit("*")))
              .otherwise(F.concat(ds, F.lit("*"))))
    name = F.when(u % 3 == 0, "_[KLM]in.dat").when(u % 3 == 1, "_[!a-z]in.dat").otherwise("_Min.dat")
    return st.select("dataset_id", F.concat(folder, F.lit("/"), ds, name).alias("file_pattern"),
                     F.lit(None).cast("string").alias("historical_suffix"))


@register("file_discovery", f"""WITH {fx.RAW_SQL}
SELECT DISTINCT dataset_id, file_name, file_role FROM raw""")
def file_discovery(spark, d):
    root, files = logger_files(spark, d)
    found = lf.discover(files, patterns(spark, d), root)
    valid = lf.scan_headers(found).filter("valid").select("file_name")
    found = found.join(valid, "file_name", "left_semi")
    return found.select("dataset_id", _base(F.col("file_name")).alias("file_name"), "file_role")


@register("rule_file_headers", f"""WITH {fx.RAW_SQL}
SELECT DISTINCT dataset_id, file_name || '.backup9' AS file_name, 'file_header' AS rule,
  'fewer than 4 header rows' AS message
FROM raw WHERE file_role = 'live' AND user_id % 7 = 0""")
def rule_file_headers(spark, d):
    root, files = logger_files(spark, d)
    matched = lf.discover(files, patterns(spark, d), root)
    bad = rules.rule_file_headers(matched, lf.scan_headers(matched))
    return bad.select("dataset_id", _base(F.col("location")).alias("file_name"), "rule", "message")


CSV_ODD, CSV_EVEN = ["timestamp", "temp", "humidity"], ["gust", "humidity", "timestamp", "temp"]


def write_csv_fixture(spark: SparkSession, d: str) -> str:
    """One CSV file per station from events; even stations have a further column and another order."""
    root = fixture_root(spark, "flat_csv_fixture", d)
    if path_exists(spark, root + "/_READY"):
        return root
    ev = fx.table(spark, d, "events")
    even = F.col("user_id") % 2 == 0
    cells = {"timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "temp": F.col("value").cast("string"),
             "humidity": F.get_json_object("props", "$.k"), "gust": _q(F.concat(F.lit("g,"), F.col("event_id").cast("string")))}

    def line(names):
        return F.concat_ws(",", *[cells[c] for c in names])

    path = F.concat(F.lit("st"), F.col("user_id").cast("string"), F.lit(".csv")).alias("path")
    body = ev.select(path, F.col("event_id").alias("seq"), F.when(even, line(CSV_EVEN)).otherwise(line(CSV_ODD)).alias("line"))
    head = ev.select(path, F.lit(-1).cast("bigint").alias("seq"),
                     F.when(even, ",".join(CSV_EVEN)).otherwise(",".join(CSV_ODD)).alias("line")).distinct()
    write_files(head.unionByName(body).repartition("path").sortWithinPartitions("path", "seq"), root)
    spark.range(1).write.mode("overwrite").parquet(root + "/_READY")
    return root


@register("csv_scan", """SELECT 'st' || user_id AS dataset_id, date_trunc('second', ts) AS time,
  value AS temp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS humidity,
  CASE WHEN user_id % 2 = 0 THEN 'g,' || event_id END AS gust FROM events""")
def csv_scan(spark, d):
    files = lf.list_files(spark, write_csv_fixture(spark, d)).filter(F.col("file_name").endswith(".csv"))
    df = flat_csv.scan_flat_csv(write_table(flat_csv.scan_headers(files), "csv_headers"))
    c = F.col("cells")
    return df.select(
        F.regexp_extract("file_name", r"/([^/]+)\.csv$", 1).alias("dataset_id"), "time",
        c["temp"].cast("double").alias("temp"), c["humidity"].cast("bigint").alias("humidity"), c["gust"].alias("gust"))


@register("logger_quality", f"""SELECT {_FILE_SQL} AS file_name, count(*) + count(*) FILTER (WHERE event_id % {UNDATED_MOD} = 0) AS n_rows,
  count(*) FILTER (WHERE event_id % {FALLBACK_MOD} = 0) AS n_fallback,
  count(*) FILTER (WHERE event_id % {UNDATED_MOD} = 0) AS n_reject,
  count(*) FILTER (WHERE {_SHORT_SQL}) AS n_short, count(*) FILTER (WHERE {_LONG_SQL}) AS n_long
FROM events GROUP BY 1""")
def logger_quality(spark, d):
    q = lf.file_quality(lf.scan_body(logger_headers(spark, d)))
    return q.select(_base(F.col("file_name")).alias("file_name"), "n_rows", "n_fallback", "n_reject",
                    "n_short", "n_long")


LB_T0, LB_T1 = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


@register("logger_build", f"""WITH base AS (
  SELECT 'st' || user_id AS dataset_id, {_FILE_SQL} AS file_name,
         CASE WHEN event_id % 3 = 2 THEN 'live' ELSE 'archived' END AS file_role,
         date_trunc('second', ts) AS time, event_id, event_type, value, user_id
  FROM events),
files AS (SELECT dataset_id, file_name, any_value(file_role) AS file_role, min(time) AS time_start
          FROM base GROUP BY dataset_id, file_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY file_role = 'live',
           time_start NULLS FIRST, file_name) AS file_rank FROM files),
dedup AS (SELECT * FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.dataset_id, b.time ORDER BY r.file_rank DESC, b.event_id DESC) AS rn
  FROM base b JOIN ranked r USING (dataset_id, file_name)) WHERE rn = 1),
{fx.FIXED_DEPS_SQL}
SELECT d.dataset_id, d.time,
  CASE WHEN event_type IN ('click', 'view') THEN value END AS air_temperature,
  CASE WHEN event_type = 'purchase' THEN value END AS relative_humidity,
  CASE WHEN event_type = 'signup' THEN CAST(value AS VARCHAR) END AS signup,
  f.lat AS latitude, f.lon AS longitude, f.elevation AS elevation
FROM dedup d LEFT JOIN fdeps f ON f.dataset_id = d.dataset_id AND d.time >= f.start
  AND (f.end_ IS NULL OR d.time < f.end_)
WHERE d.time >= TIMESTAMP '{LB_T0}' AND d.time <= TIMESTAMP '{LB_T1}'""")
def logger_build(spark, d):
    """The data query from the logger files themselves: bodies are read and parsed once into a
    bronze table; the file index, ranks, dedup, mapping, deployments and the window read bronze."""
    raw, _ = ingested(spark, d)
    index = write_table(rec.classify_roles(rec.file_bounds(raw)), "file_index")
    return build_dataset(raw, fx.EVENT_SPECS, fx.deployments(spark, d, "fixed"), "fixed", LB_T0, LB_T1, file_index=index)
