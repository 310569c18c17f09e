"""Station-domain tables derived by Spark from the driver's tables.

``events`` plays a telemetry fleet (station = user, raw column = event type,
reading = value); ``event_id % 3`` picks the file a reading was logged in
(2 = live, 1 = archived ``_Historical``, 0 = archived ``.backup``);
``orders`` plays config versions and monthly data; ``lineitem`` per
supplier and year plays a file index; ``customer`` x ``nation`` x
``region`` plays the dataset catalog; ``part`` supplies column names for
profiling. Every table here grows with its input; the literal templates
below are configuration (bounded, a few rows).

Each Spark derivation has an SQL twin (``*_SQL``) used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.operators.index import with_change_token
from fleetseries.schemas import DEPLOYMENTS

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# telemetry view of events

def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("device"),
        F.col("event_type").alias("key"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("value").cast("string").alias("value"),
    )


TELEMETRY_SQL = """tele AS (
  SELECT 'st' || user_id AS device, event_type AS key, epoch_us(ts) // 1000 AS ts_ms, value, event_id
  FROM events)"""


# ---------------------------------------------------------------------------
# logger-file view of events: one raw row per event, hourly logger clock

FILE_SUFFIX = {2: "_Min.dat", 1: "_Min_Historical.dat", 0: "_Min.dat.backup"}


def file_name_col(user_id, event_id):
    m = event_id % 3
    return F.concat(
        F.lit("st"), user_id.cast("string"),
        F.when(m == 2, F.lit(FILE_SUFFIX[2])).when(m == 1, F.lit(FILE_SUFFIX[1])).otherwise(F.lit(FILE_SUFFIX[0])),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset_id, file_name, block_start, row_pos, time, ts, cells (+ event columns)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("dataset_id"),
        file_name_col(F.col("user_id"), F.col("event_id")).alias("file_name"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("row_pos"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        "ts", "user_id", "event_id", "event_type", "value", "props",
        F.create_map(F.col("event_type"), F.col("value").cast("string")).alias("cells"),
    )


RAW_SQL = """raw AS (
  SELECT 'st' || user_id AS dataset_id,
         'st' || user_id || CASE event_id % 3 WHEN 2 THEN '_Min.dat' WHEN 1 THEN '_Min_Historical.dat'
                                ELSE '_Min.dat.backup' END AS file_name,
         CASE WHEN event_id % 3 = 2 THEN 'live' ELSE 'archived' END AS file_role,
         event_id AS row_pos, date_trunc('hour', ts) AS time, ts, user_id, event_id, event_type, value
  FROM events)"""

FILES_SQL = RAW_SQL + """,
files AS (
  SELECT dataset_id, file_name, any_value(file_role) AS file_role, min(time) AS time_start
  FROM raw GROUP BY dataset_id, file_name),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id
         ORDER BY file_role = 'live', time_start NULLS FIRST, file_name) AS INTEGER) AS file_rank
  FROM files)"""

DEDUP_SQL = FILES_SQL + """,
dedup AS (
  SELECT r.* FROM (
    SELECT raw.*, k.file_rank, row_number() OVER (PARTITION BY raw.dataset_id, raw.time
           ORDER BY k.file_rank DESC, raw.row_pos DESC) AS rn
    FROM raw JOIN ranked k USING (dataset_id, file_name)) r
  WHERE rn = 1)"""


def keep_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry semantics on the hourly clock: newest reading per (station, key, hour)."""
    raw = raw_rows(spark, sf_dir)
    return raw.groupBy("dataset_id", "time", F.col("event_type").alias("raw_name")).agg(
        F.max_by(F.col("value").cast("string"), "ts").alias("raw_value"),
        F.max_by("value", "ts").alias("value"),
    )


KEYLAST_SQL = RAW_SQL + """,
keylast AS (
  SELECT dataset_id, time, event_type AS raw_name, arg_max(value, ts) AS value
  FROM raw GROUP BY dataset_id, time, event_type)"""


# ---------------------------------------------------------------------------
# deployments: template windows per station group (user_id % 3)

FIXED_TEMPLATE = [
    # grp, dep_ord, start, end, lat, lon, elevation
    (0, 0, "2024-01-01 00:00:00", "2024-01-10 00:00:00", 78.22, 15.65, 10.0),
    (0, 1, "2024-01-10 00:00:00", None, 78.92, 11.93, None),
    (1, 0, "2024-01-05 00:00:00", "2024-01-20 00:00:00", 60.0, 10.0, 5.0),
    (1, 1, "2024-01-20 00:00:00", "2024-01-25 12:00:00", 61.0, 11.0, 6.0),
    (2, 0, "2023-12-01 00:00:00", "2024-01-15 12:00:00", 69.65, 18.96, 20.0),
    (2, 1, "2024-01-16 00:00:00", None, 69.7, 19.0, 21.0),
]
MOBILE_TEMPLATE = [
    (0, 0, "2024-01-01 00:00:00", "2024-01-12 00:00:00", "RV Lance"),
    (0, 1, "2024-01-12 00:00:00", None, "RV Kronprins Haakon"),
    (1, 0, "2024-01-03 00:00:00", "2024-01-18 00:00:00", "Buoy A"),
    (2, 0, "2024-01-01 00:00:00", None, "Glider 7"),
]


def _values_sql(rows, cols):
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def deployments(spark: SparkSession, sf_dir: str, platform_type: str = "fixed") -> DataFrame:
    """Per-station deployment table: each station's windows are exploded from
    its group's template array (as they would be from its config document)."""
    ev = table(spark, sf_dir, "events")
    stations = ev.select("user_id").distinct()
    template = FIXED_TEMPLATE if platform_type == "fixed" else MOBILE_TEMPLATE

    def dep(row):
        if platform_type == "fixed":
            grp, k, start, end, lat, lon, elev = row
            name = None
        else:
            grp, k, start, end, name = row
            lat = lon = elev = None
        return F.struct(
            F.lit(k).alias("dep_ord"), F.lit(start).cast("timestamp_ntz").alias("start"),
            F.lit(end).cast("timestamp_ntz").alias("end"), F.lit(lat).cast("double").alias("lat"),
            F.lit(lon).cast("double").alias("lon"), F.lit(elev).cast("double").alias("elevation"),
            F.lit(name).cast("string").alias("platform_name"))

    grp = (F.col("user_id") % 3).cast("int")
    arrays = None
    for g in sorted({r[0] for r in template}):
        arr = F.array(*[dep(r) for r in template if r[0] == g])
        arrays = F.when(grp == g, arr) if arrays is None else arrays.when(grp == g, arr)
    out = stations.select(F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("dataset_id"),
                          F.explode(arrays).alias("d")).select("dataset_id", "d.*")
    out = out.withColumn("instrument_config", F.lit(None).cast("string")).withColumn(
        "notes", F.lit(None).cast("string"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in DEPLOYMENTS.fields])


FIXED_DEPS_SQL = "fdeps AS (SELECT 'st' || s.user_id AS dataset_id, t.dep_ord, CAST(t.start AS TIMESTAMP) AS start, " \
    "CAST(t.end_ AS TIMESTAMP) AS end_, t.lat, t.lon, t.elevation FROM (SELECT DISTINCT user_id FROM events) s " \
    "JOIN " + _values_sql(FIXED_TEMPLATE, ["grp", "dep_ord", "start", "end_", "lat", "lon", "elevation"]) + \
    " ON s.user_id % 3 = t.grp)"
MOBILE_DEPS_SQL = "mdeps AS (SELECT 'st' || s.user_id AS dataset_id, t.dep_ord, CAST(t.start AS TIMESTAMP) AS start, " \
    "CAST(t.end_ AS TIMESTAMP) AS end_, t.platform_name FROM (SELECT DISTINCT user_id FROM events) s " \
    "JOIN " + _values_sql(MOBILE_TEMPLATE, ["grp", "dep_ord", "start", "end_", "platform_name"]) + \
    " ON s.user_id % 3 = t.grp)"


# ---------------------------------------------------------------------------
# variable configs used with the event stations (configuration literals)

EVENT_SPECS = [
    {"raw_name": "click", "old_names": ["view"], "standard_name": "air_temperature", "units": "degC"},
    {"raw_name": "purchase", "standard_name": "relative_humidity", "units": "%"},
    {"raw_name": "signup", "dtype": "string"},
]
STACKED_SPECS = [
    {"standard_name": "air_temperature", "units": "degC",
     "extra_dimension": {"name": "height", "units": "m"},
     "members": [{"raw_name": "click", "dimension_value": 30},
                 {"raw_name": "view", "dimension_value": 2},
                 {"raw_name": "purchase", "dimension_value": 10},
                 {"raw_name": "absent_sensor", "dimension_value": 50}]},
    {"raw_name": "error", "standard_name": "wind_speed", "units": "m/s"},
    {"raw_name": "signup", "dtype": "string"},
]
TWO_DIM_SPECS = [
    {"standard_name": "air_temperature", "units": "degC",
     "extra_dimension": [{"name": "height", "units": "m"}, {"name": "channel", "units": ""}],
     "members": [{"raw_name": "click", "dimension_value": [2, "ch1"]},
                 {"raw_name": "view", "dimension_value": [2, "ch2"]},
                 {"raw_name": "purchase", "dimension_value": [10, "ch1"]}]},
]


# ---------------------------------------------------------------------------
# file index from lineitem: one file per (supplier, ship year)

def lineitem_files(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    if before is not None:
        li = li.filter(F.col("l_shipdate") < F.lit(before).cast("timestamp_ntz"))
    f = li.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(
        F.min("l_shipdate").alias("time_start"), F.max("l_shipdate").alias("time_end"),
        F.count(F.lit(1)).alias("size"))
    last = f.groupBy("l_suppkey").agg(F.max("yr").alias("last_yr"))
    f = f.join(last, "l_suppkey")
    return f.select(
        F.concat(F.lit("sup"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("sup"), F.col("l_suppkey").cast("string"), F.lit("/"),
                 F.col("yr").cast("string"), F.when(F.col("yr") == F.col("last_yr"), F.lit(".dat"))
                 .otherwise(F.lit("_Historical.dat"))).alias("file_name"),
        F.when(F.col("yr") == F.col("last_yr"), "live").otherwise("archived").alias("file_role"),
        F.col("size").cast("bigint").alias("size"), "time_start", "time_end",
        F.array(F.lit("l_quantity"), F.lit("l_extendedprice")).alias("variables"),
    )


def lineitem_files_sql(name: str, before: str | None = None) -> str:
    where = f"WHERE l_shipdate < TIMESTAMP '{before}'" if before else ""
    return f"""{name} AS (
  SELECT 'sup' || l_suppkey AS dataset_id,
         'sup' || l_suppkey || '/' || yr || CASE WHEN yr = last_yr THEN '.dat' ELSE '_Historical.dat' END AS file_name,
         CASE WHEN yr = last_yr THEN 'live' ELSE 'archived' END AS file_role,
         size, time_start, time_end
  FROM (SELECT l_suppkey, year(l_shipdate) AS yr, min(l_shipdate) AS time_start, max(l_shipdate) AS time_end,
               count(*) AS size, max(year(l_shipdate)) OVER (PARTITION BY l_suppkey) AS last_yr
        FROM lineitem {where} GROUP BY l_suppkey, year(l_shipdate)))"""


def index_listing(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Listing of three source types: logger files (supplier and year), one flat CSV file per supplier
    (modified at its last shipment), one telemetry device per customer (newest order). ``before``: an earlier state."""
    files = lineitem_files(spark, sf_dir, before).select(
        "*", F.lit("loggernet").alias("source_type"), F.lit(None).cast("timestamp_ntz").alias("modified"),
        F.lit(None).cast("bigint").alias("last_ts_ms"))
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if before is not None:
        limit = F.lit(before).cast("timestamp_ntz")
        li, orders = li.filter(F.col("l_shipdate") < limit), orders.filter(F.col("o_orderdate") < limit)
    csv = li.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("time_start"), F.max("l_shipdate").alias("time_end"),
                                      F.count("*").alias("size"), F.max("l_shipdate").alias("modified"))
    csv = csv.select(
        F.concat(F.lit("csv"), F.col("l_suppkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("csv"), F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("file_name"), F.lit("live").alias("file_role"),
        "size", "time_start", "time_end", F.array(F.lit("l_quantity")).alias("variables"), F.lit("generic_csv").alias("source_type"),
        F.col("modified").cast("timestamp_ntz").alias("modified"), F.lit(None).cast("bigint").alias("last_ts_ms"))
    dev = F.concat(F.lit("dev"), F.col("o_custkey").cast("string"))
    devices = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("time_start"), F.max("o_orderdate").alias("time_end")).select(
        dev.alias("dataset_id"), dev.alias("file_name"), F.lit("live").alias("file_role"), F.lit(0).cast("bigint").alias("size"),
        "time_start", "time_end", F.array(F.lit("o_totalprice")).alias("variables"), F.lit("thingsboard").alias("source_type"),
        F.lit(None).cast("timestamp_ntz").alias("modified"), F.unix_millis(F.col("time_end").cast("timestamp")).alias("last_ts_ms"))
    return files.unionByName(csv).unionByName(devices)


def index_listing_sql(name: str, before: str | None = None) -> str:
    where = f"WHERE l_shipdate < TIMESTAMP '{before}'" if before else ""
    owhere = f"WHERE o_orderdate < TIMESTAMP '{before}'" if before else ""
    return lineitem_files_sql(f"{name}_files", before) + f""",
{name} AS (
  SELECT * FROM {name}_files
  UNION ALL SELECT 'csv' || l_suppkey, 'csv' || l_suppkey || '.csv', 'live', epoch_us(CAST(max(l_shipdate) AS TIMESTAMP)),
    min(l_shipdate), max(l_shipdate) FROM lineitem {where} GROUP BY l_suppkey
  UNION ALL SELECT 'dev' || o_custkey, 'dev' || o_custkey, 'live', epoch_ms(CAST(max(o_orderdate) AS TIMESTAMP)),
    min(o_orderdate), max(o_orderdate) FROM orders {owhere} GROUP BY o_custkey)"""


def previous_index(spark: SparkSession, sf_dir: str, before: str) -> DataFrame:
    """Stored index as of an earlier snapshot: archived closed; live entries
    active for even keys, closed for odd ones."""
    f = with_change_token(index_listing(spark, sf_dir, before))
    key = F.regexp_extract("dataset_id", r"(\d+)$", 1).cast("bigint")
    status = F.when(F.col("file_role") == "archived", "closed").when(key % 2 == 0, "active").otherwise("closed")
    return f.withColumn("status", status)


def previous_index_sql(before: str) -> str:
    return index_listing_sql("prevfiles", before) + """,
prev AS (SELECT *, CASE WHEN file_role = 'archived' THEN 'closed'
                   WHEN CAST(substr(dataset_id, 4) AS BIGINT) % 2 = 0 THEN 'active' ELSE 'closed' END AS status
         FROM prevfiles)"""


# ---------------------------------------------------------------------------
# config versions from orders

def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    content = F.concat(
        F.lit('{"id":"cust'), F.col("o_custkey").cast("string"), F.lit('","status":"'),
        F.col("o_orderstatus"), F.lit('","priority":"'), F.col("o_orderpriority"), F.lit('"}'))
    return o.select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("dataset_id"),
        F.col("o_orderkey").alias("version_id"),
        content.alias("content"),
        F.col("o_orderdate").alias("created_at"),
    )


VERSIONS_SQL = """versions AS (
  SELECT 'cust' || o_custkey AS dataset_id, o_orderkey AS version_id,
         '{"id":"cust' || o_custkey || '","status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}'
           AS content,
         o_orderdate AS created_at
  FROM orders)"""


def order_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("dataset_id")).agg(
        F.min("o_orderdate").alias("data_start"), F.max("o_orderdate").alias("data_end"))


ORDER_COVERAGE_SQL = """cov AS (
  SELECT 'cust' || o_custkey AS dataset_id, min(o_orderdate) AS data_start, max(o_orderdate) AS data_end
  FROM orders GROUP BY o_custkey)"""


# ---------------------------------------------------------------------------
# catalog documents from customer x nation x region

SEGMENT_VARIABLES = {
    "BUILDING": '[{"raw_name":"AirT_C","standard_name":"air_temperature","units":"degC"},'
                '{"raw_name":"RH","standard_name":"relative_humidity","units":"%"}]',
    "AUTOMOBILE": '[{"raw_name":"WS_ms","standard_name":"wind_speed","units":"m/s"},'
                  '{"raw_name":"Lat","standard_name":"latitude","units":"degrees_north"},'
                  '{"raw_name":"Lon","standard_name":"longitude","units":"degrees_east"}]',
    "MACHINERY": '[{"raw_name":"BP_mbar","standard_name":"air_pressure","units":"mbar"},'
                 '{"raw_name":"status","dtype":"string"}]',
    "HOUSEHOLD": '[{"raw_name":"AirT_C","standard_name":"air_temperature","units":"degC"},'
                 '{"standard_name":"air_temperature","units":"degC","extra_dimension":{"name":"height","units":"m"},'
                 '"members":[{"raw_name":"T2","dimension_value":2},{"raw_name":"T10","dimension_value":10}]}]',
    "FURNITURE": '[{"raw_name":"SST_Avg","standard_name":"sea_surface_temperature","units":"degC"}]',
}
SEGMENT_NAMES = {
    "BUILDING": ["air_temperature", "relative_humidity"],
    "AUTOMOBILE": ["latitude", "longitude", "wind_speed"],
    "MACHINERY": ["air_pressure"],
    "HOUSEHOLD": ["air_temperature"],
    "FURNITURE": ["sea_surface_temperature"],
}
SEGMENT_N_VARS = {"BUILDING": 2, "AUTOMOBILE": 3, "MACHINERY": 2, "HOUSEHOLD": 2, "FURNITURE": 1}

# injected problems, by customer key and platform: SQL that Spark and the SQL twins share
_FIXED, _MOBILE = "platform_type = 'fixed' AND ", "platform_type = 'mobile' AND "
BROKEN = "c_custkey % 97 = 5"                                   # not JSON at all
PROBLEMS = {
    "unknown_key": "c_custkey % 13 = 0",                        # extra root key "colour"
    "both_shapes": "c_custkey % 17 = 0",                        # variable with raw_name and extra_dimension
    "arity": "c_custkey % 19 = 0",                              # two dims, scalar member value
    "collision": "c_custkey % 23 = 0",                          # raw name mapped twice
    "end_before": _FIXED + "c_custkey % 29 = 0",                # deployment end <= start
    "bad_date": _FIXED + "c_custkey % 41 = 0 AND c_custkey % 29 <> 0",     # end is no time
    "open_first": _FIXED + "c_custkey % 47 = 0 AND c_custkey % 29 <> 0 AND c_custkey % 41 <> 0",  # open, not last
    "unsorted": _FIXED + "c_custkey % 53 = 0",                  # second deployment starts earlier
    "overlap": _FIXED + "c_custkey % 37 = 0 AND c_custkey % 29 <> 0 AND c_custkey % 41 <> 0 "
                        "AND c_custkey % 47 <> 0 AND c_custkey % 53 <> 0",
    "no_position": _FIXED + "c_custkey % 59 = 0",               # fixed deployment without a latitude
    "fixed_named": _FIXED + "c_custkey % 61 = 0",               # fixed deployment that names a platform
    "bad_elevation": _FIXED + "c_custkey % 67 = 0",             # elevation is text
    "mobile_unnamed": _MOBILE + "c_custkey % 31 = 0",           # mobile deployment without a platform
    "mobile_position": _MOBILE + "c_custkey % 43 = 0",          # mobile deployment carrying a latitude
    "mobile_names": _MOBILE + "c_custkey % 71 = 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 "
                              "AND c_custkey % 23 <> 0",        # no position variables
    "no_title": "c_custkey % 73 = 0",
    "bad_access": "c_custkey % 79 = 0",
    "bad_publish": "c_custkey % 83 = 0",
    "bad_license": "c_custkey % 89 = 0",                        # license is a number
}
GENERIC = "c_custkey % 3 = 0"                                   # datasets with a flat CSV source


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, content, c_custkey): one JSON document per customer."""
    # a customer is far smaller than its document, so a file of a great many would be built by one task
    c = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism)
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    platform = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "mobile").otherwise("fixed")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).withColumn("platform_type", platform)
    k = F.col("c_custkey")
    ds = F.concat(F.lit("cust"), k.cast("string"))

    def either(problem, bad, good=""):
        bad, good = (F.lit(x) if isinstance(x, str) else x for x in (bad, good))
        return F.when(F.expr(PROBLEMS[problem]), bad).otherwise(good)

    seg_vars = F.coalesce(*[F.when(F.col("c_mktsegment") == s, F.lit(v)) for s, v in SEGMENT_VARIABLES.items()],
                          F.lit("[]"))
    seg_vars = either("mobile_names", '[{"raw_name":"WS_ms","standard_name":"wind_speed","units":"m/s"}]', seg_vars)
    extra_vars = F.concat(
        either("both_shapes", ',{"raw_name":"X1","standard_name":"x","extra_dimension":'
                              '{"name":"h","units":"m"},"members":[{"raw_name":"X1a","dimension_value":1}]}'),
        either("arity", ',{"standard_name":"y","extra_dimension":[{"name":"h","units":"m"},'
                        '{"name":"c","units":""}],"members":[{"raw_name":"Y1","dimension_value":3}]}'),
        either("collision", ',{"raw_name":"dup_a"},{"raw_name":"dup_b","old_names":["dup_a"]}'),
    )
    variables = F.concat(F.expr("substring(seg_vars, 1, length(seg_vars) - 1)"), extra_vars, F.lit("]"))
    mobile = F.col("platform_type") == "mobile"
    lat = (F.lit(60) + F.col("c_nationkey")).cast("string")
    lon = (F.col("c_nationkey") * 2).cast("string")
    end = either("end_before", '"2019-06-01T00:00:00"',
                 either("bad_date", '"soon"', either("open_first", "null", '"2022-01-01T00:00:00"')))
    dep_fixed = F.concat(F.lit('{"start":"2020-01-01T00:00:00","end":'), end,
                         either("no_position", "", F.concat(F.lit(',"lat":'), lat)), F.lit(',"lon":'), lon,
                         either("fixed_named", ',"platform_name":"P"'), F.lit("}"))
    dep_fixed2 = F.concat(F.lit(',{"start":'),
                          either("unsorted", '"2019-01-01T00:00:00"', either("overlap", '"2021-06-01T00:00:00"', '"2022-01-01T00:00:00"')),
                          F.lit(',"lat":'), lat, F.lit(',"lon":'), (F.col("c_nationkey") * 2 + 1).cast("string"),
                          F.lit(',"elevation":'), either("bad_elevation", '"high"', (k % 100).cast("string")), F.lit("}"))
    dep_mobile = F.concat(F.lit('{"start":"2020-01-01T00:00:00"'),
                          either("mobile_unnamed", "", F.concat(F.lit(',"platform_name":"RV '), F.col("n_name"), F.lit('"'))),
                          either("mobile_position", ',"lat":1'), F.lit("}"))
    deps = F.when(mobile, F.concat(F.lit("["), dep_mobile, F.lit("]"))).otherwise(
        F.concat(F.lit("["), dep_fixed, dep_fixed2, F.lit("]")))
    access = either("bad_access", "secret", F.when(F.col("c_acctbal") < 0, "restricted").otherwise("public"))
    source = F.when(F.expr(GENERIC), F.concat(F.lit('"generic_csv","source_config":{"file_path":"'), ds, F.lit('.csv"}'))) \
        .otherwise(F.concat(F.lit('"thingsboard","source_config":{"device_name":"'), ds, F.lit('"}')))
    content = F.concat(
        F.lit('{"id":"'), ds, F.lit('","access":"'), access, F.lit('","source_type":'), source, F.lit(',"variables":'), variables,
        F.lit(',"platform_type":"'), F.col("platform_type"), F.lit('","deployments":'), deps,
        F.lit(',"metadata":{'), either("no_title", "", F.concat(F.lit('"title":"'), F.col("c_name"), F.lit('",'))),
        either("bad_license", '"license":12,'), F.lit('"institution":"'), F.col("r_name"),
        F.lit('","department":"'), F.col("c_mktsegment"), F.lit('","country":"'), F.col("n_name"),
        F.lit('"},"output":{"file_naming":"{station}_{yyyy}{mm}.nc","publish":'),
        either("bad_publish", '"maybe"', F.when(k % 2 == 0, "true").otherwise("false")), F.lit("}"),
        either("unknown_key", ',"colour":"red"'), F.lit("}"),
    )
    content = F.when(F.expr(BROKEN), F.concat(F.lit('{"id": "'), ds, F.lit('", "broken'))).otherwise(content)
    return j.withColumn("seg_vars", seg_vars).select(ds.alias("dataset_id"), content.alias("content"),
                                                     "c_custkey")


def _case_sql(mapping: dict[str, str], col: str = "c_mktsegment") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


CATALOG_SQL = f"""cat AS (
  SELECT 'cust' || c_custkey AS dataset_id, c_custkey, CASE WHEN NOT ({PROBLEMS["no_title"]}) THEN c_name END AS title,
         r_name AS institution, c_mktsegment AS department, n_name AS country, c_nationkey,
         CASE WHEN {PROBLEMS["bad_access"]} THEN 'secret' WHEN c_acctbal < 0 THEN 'restricted' ELSE 'public' END AS access,
         CASE WHEN {GENERIC} THEN 'generic_csv' ELSE 'thingsboard' END AS source_type,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'mobile' ELSE 'fixed' END AS platform_type,
         c_custkey % 2 = 0 AND NOT ({PROBLEMS["bad_publish"]}) AS publish,
         {_case_sql({k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in SEGMENT_NAMES.items()})}
           AS standard_names,
         {_case_sql({k: str(v) for k, v in SEGMENT_N_VARS.items()})}
           + CASE WHEN {PROBLEMS["both_shapes"]} THEN 1 ELSE 0 END
           + CASE WHEN {PROBLEMS["arity"]} THEN 1 ELSE 0 END
           + CASE WHEN {PROBLEMS["collision"]} THEN 2 ELSE 0 END AS n_variables,
         NOT ({BROKEN}) AS parsed_ok
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
VIOLATION_SQL = "(NOT parsed_ok OR " + " OR ".join(f"({c})" for c in PROBLEMS.values()) + ")"


def part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned column names per 'dataset' (p_type) built from part rows."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_type").alias("dataset_id"),
        F.concat(F.lit("AirTC_"), F.col("p_size").cast("string"), F.lit("m_"),
                 F.regexp_replace("p_brand", "#", "")).alias("column_name"),
        "p_partkey", "p_name", "p_size", "p_retailprice", "p_brand",
    )


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile positions: latitude from value (missing for 'error' readings),
    longitude from props.k."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.col("ts").alias("time"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
        .otherwise(F.col("value") / 10 + 30).alias("latitude"),
        F.get_json_object("props", "$.k").cast("double").alias("longitude"),
    )


POSITIONS_SQL = """pos AS (
  SELECT 'st' || user_id AS dataset_id, ts AS time,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 10 + 30 END AS latitude,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS longitude
  FROM events)"""
