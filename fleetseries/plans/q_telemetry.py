"""Telemetry, predicates and coercion queries (events as a station fleet)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.functions.scalar import na_to_null, parse_number, to_naive_utc
from fleetseries.operators import mapping as map_ops
from fleetseries.operators import reconcile as rec
from fleetseries.operators import tracks
from fleetseries.plans import fixtures as fx
from fleetseries.plans.build import build_dataset
from fleetseries.plans.registry import register
from fleetseries.schemas import LOGGER_NA_TOKENS, NUMBER_PATTERN
from fleetseries.sources import telemetry as tel

KEYS = fx.EVENT_TYPES


def _pivot_sql() -> str:
    cols = ",\n  ".join(f"max(value) FILTER (WHERE key = '{k}') AS {k}" for k in KEYS)
    return f"""WITH {fx.TELEMETRY_SQL}
SELECT device AS dataset_id, epoch_ms(ts_ms) AS time,
  {cols}
FROM tele GROUP BY device, ts_ms"""


@register("telemetry_pivot", _pivot_sql())
def telemetry_pivot(spark, d):
    return tel.pivot_keys(fx.telemetry(spark, d), KEYS).withColumnRenamed("device", "dataset_id")


@register("telemetry_outer_join", _pivot_sql())
def telemetry_outer_join(spark, d):
    tele = fx.telemetry(spark, d)
    series = {k: tele.filter(F.col("key") == k) for k in KEYS}
    return tel.align_series(series).withColumnRenamed("device", "dataset_id")


@register("latest_telemetry", f"""WITH {fx.TELEMETRY_SQL}
SELECT device AS dataset_id, key, max(ts_ms) AS last_ts_ms, arg_max(value, ts_ms) AS last_value,
       max(max(ts_ms)) OVER (PARTITION BY device) AS change_token
FROM tele GROUP BY device, key""")
def latest_telemetry(spark, d):
    out = tel.latest_per_key(fx.telemetry(spark, d))
    return out.select(F.col("device").alias("dataset_id"), "key", "last_ts_ms",
                      parse_number("last_value").alias("last_value"), "change_token")


WINDOW_KEYS = ["click", "view"]


@register("telemetry_window", f"""WITH {fx.TELEMETRY_SQL}
SELECT device AS dataset_id, epoch_ms(ts_ms) AS time, max(value) FILTER (WHERE key = 'click') AS click,
  max(value) FILTER (WHERE key = 'view') AS view
FROM tele WHERE key IN ('click', 'view') AND ts_ms BETWEEN epoch_ms(TIMESTAMP '2024-01-10') AND epoch_ms(TIMESTAMP '2024-01-20')
GROUP BY device, ts_ms""")
def telemetry_window(spark, d):
    """A key list and an inclusive time range, pushed below the grouping."""
    tele = tel.select_window(fx.telemetry(spark, d), WINDOW_KEYS, T0, T1)
    return tel.pivot_keys(tele, WINDOW_KEYS).withColumnRenamed("device", "dataset_id")


T0, T1 = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@register("time_range", f"""WITH {fx.KEYLAST_SQL}
SELECT dataset_id, time, raw_name AS variable, value FROM keylast
WHERE time >= TIMESTAMP '{T0}' AND time <= TIMESTAMP '{T1}'""")
def time_range(spark, d):
    kl = fx.keep_last_per_key(spark, d)
    out = rec.time_window(kl, T0, T1)
    return out.select("dataset_id", "time", F.col("raw_name").alias("variable"), "value") \
        .orderBy("dataset_id", "time", "variable")


@register("tz_normalize", """SELECT event_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') || ':00' AS local_text,
  date_trunc('second', ts) - to_hours(CAST(user_id % 10 AS INTEGER)) AS time
FROM events""")
def tz_normalize(spark, d):
    ev = fx.table(spark, d, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+"),
                    F.lpad((F.col("user_id") % 10).cast("string"), 2, "0"), F.lit(":00"))
    return ev.select("event_id", text.alias("local_text"), to_naive_utc(text).alias("time"))


SELECT_VARS = ["relative_humidity", "nonexistent", "air_temperature"]


@register("variable_select", f"""WITH {fx.DEDUP_SQL}
SELECT dataset_id, time,
  CASE WHEN event_type = 'purchase' THEN value END AS relative_humidity,
  CASE WHEN event_type IN ('click', 'view') THEN value END AS air_temperature
FROM dedup""")
def variable_select(spark, d):
    return build_dataset(fx.raw_rows(spark, d), fx.EVENT_SPECS, None, variables=SELECT_VARS)


RESOLVE_VARS = ["air_temperature", "signup", "unknown_variable"]


@register("column_resolve", f"""WITH {fx.RAW_SQL}
SELECT dataset_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'air_temperature' ELSE 'signup' END AS canonical_name,
  event_type AS raw_name, count(*) AS n_cells
FROM raw WHERE event_type IN ('click', 'view', 'signup')
GROUP BY dataset_id, event_type""")
def column_resolve(spark, d):
    vmap = map_ops.restrict_to_variables(
        map_ops.variable_map_from_specs(spark, fx.EVENT_SPECS), RESOLVE_VARS)
    needed = vmap.select("canonical_name", "raw_name")
    cells = map_ops.explode_cells(fx.raw_rows(spark, d))
    present = cells.groupBy("dataset_id", "raw_name").agg(F.count(F.lit(1)).alias("n_cells"))
    return present.join(F.broadcast(needed), "raw_name").select(
        "dataset_id", "canonical_name", "raw_name", "n_cells")


NA_CASES = ["NAN", "#N/A", "null", "", "n/a", "NaN", "None", "N/A ", "-nan", "<NA>"]


def _na_raw_spark(ev):
    m = F.col("event_id") % 25
    expr = F.col("value").cast("string")
    for i in reversed(range(len(NA_CASES))):
        expr = F.when(m == i, F.lit(NA_CASES[i])).otherwise(expr)
    return expr


def _case_sql(cases, mod, default):
    whens = " ".join("WHEN {} THEN '{}'".format(i, c.replace("'", "''")) for i, c in enumerate(cases))
    return f"CASE event_id % {mod} {whens} ELSE {default} END"


def _sql_list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@register("na_tokens", f"""SELECT event_id, raw_value,
  CASE WHEN raw_value IN ({_sql_list(LOGGER_NA_TOKENS)}) THEN NULL ELSE raw_value END AS cleaned
FROM (SELECT event_id, {_case_sql(NA_CASES, 25, 'CAST(value AS VARCHAR)')} AS raw_value FROM events)""")
def na_tokens(spark, d):
    ev = fx.table(spark, d, "events")
    raw = ev.select("event_id", _na_raw_spark(ev).alias("raw_value"))
    return raw.withColumn("cleaned", na_to_null("raw_value", LOGGER_NA_TOKENS))


BAD_CASES = ["ERROR", "1.5f", " 2 ", "NaN", "0x10", "1e3", ".5", "5.", "+3", "1,5", "inf", "1_000", "True"]
_SQL_PATTERN = NUMBER_PATTERN.replace("'", "''")


def _bad_raw_spark():
    m = F.col("event_id") % 50
    expr = F.col("value").cast("string")
    for i in reversed(range(len(BAD_CASES))):
        expr = F.when(m == i, F.lit(BAD_CASES[i])).otherwise(expr)
    return expr


_COERCE_SQL = f"""coerced AS (
  SELECT event_id, 'st' || user_id AS dataset_id, event_type, raw_value,
         CASE WHEN regexp_matches(raw_value, '{_SQL_PATTERN}') THEN TRY_CAST(trim(raw_value) AS DOUBLE) END
           AS value_num
  FROM (SELECT *, {_case_sql(BAD_CASES, 50, 'CAST(value AS VARCHAR)')} AS raw_value FROM events))"""


@register("coerce_numeric", f"""WITH {_COERCE_SQL}
SELECT event_id, raw_value, value_num, value_num IS NULL AS bad FROM coerced""")
def coerce_numeric(spark, d):
    ev = fx.table(spark, d, "events")
    obs = ev.select("event_id", _bad_raw_spark().alias("raw_value"), F.lit("numeric").alias("dtype"))
    return map_ops.coerce(obs).select("event_id", "raw_value", "value_num", "bad")


@register("quality_warnings", f"""WITH {_COERCE_SQL}
SELECT dataset_id, event_type AS canonical_name, count(*) AS n_bad,
  event_type || ': ' || count(*) || ' value(s) could not be parsed as numeric and were set to NaN (examples: ['
    || array_to_string(list_transform(list_sort(list(DISTINCT raw_value)), lambda x: '''' || x || ''''), ', ')
    || '])' AS warning
FROM coerced WHERE value_num IS NULL GROUP BY dataset_id, event_type""")
def quality_warnings(spark, d):
    ev = fx.table(spark, d, "events")
    obs = ev.select(
        F.concat(F.lit("st"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.col("event_type").alias("canonical_name"), F.lit(0).alias("var_ord"),
        _bad_raw_spark().alias("raw_value"), F.lit("numeric").alias("dtype"))
    rep = map_ops.quality_report(map_ops.coerce(obs))
    return rep.select("dataset_id", "canonical_name", "n_bad", "warning")


NOW_TRACK = "2024-01-31 00:00:00"


@register("mobile_track", f"""WITH {fx.POSITIONS_SQL}
SELECT dataset_id, time, latitude, longitude FROM pos
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND time >= TIMESTAMP '2024-01-24 00:00:00'""")
def mobile_track(spark, d):
    return tracks.recent_track(fx.event_positions(spark, d), NOW_TRACK).select(
        "dataset_id", "time", "latitude", "longitude")


@register("latest_position", f"""WITH {fx.POSITIONS_SQL}
SELECT dataset_id, max(time) AS time, arg_max(latitude, time) AS latitude, arg_max(longitude, time) AS longitude,
       count(*) AS n_points
FROM pos WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY dataset_id""")
def latest_position(spark, d):
    return tracks.latest_position(fx.event_positions(spark, d))


FLAG_T0, FLAG_T1 = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
FLAGSHIP_SQL = f"""WITH {fx.DEDUP_SQL}, {fx.FIXED_DEPS_SQL}
SELECT d.dataset_id, d.time,
  CASE WHEN event_type IN ('click', 'view') THEN value END AS air_temperature,
  CASE WHEN event_type = 'purchase' THEN value END AS relative_humidity,
  CASE WHEN event_type = 'signup' THEN CAST(value AS VARCHAR) END AS signup,
  f.lat AS latitude, f.lon AS longitude, f.elevation AS elevation
FROM dedup d LEFT JOIN fdeps f ON f.dataset_id = d.dataset_id AND d.time >= f.start
  AND (f.end_ IS NULL OR d.time < f.end_)
WHERE d.time >= TIMESTAMP '{FLAG_T0}' AND d.time <= TIMESTAMP '{FLAG_T1}'"""


@register("build_dataset", FLAGSHIP_SQL)
def flagship(spark, d):
    """The data query: dedup, map, deployments, inclusive window (wide)."""
    return build_dataset(fx.raw_rows(spark, d), fx.EVENT_SPECS, fx.deployments(spark, d, "fixed"),
                         "fixed", FLAG_T0, FLAG_T1)

