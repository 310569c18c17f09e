"""Variable mapping, stacking, wide export, sinks and deployment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.operators import coverage as cov
from fleetseries.operators import deployment as dep_ops
from fleetseries.operators import export as exp
from fleetseries.operators import mapping as map_ops
from fleetseries.operators import reconcile as rec
from fleetseries.plans import fixtures as fx
from fleetseries.plans.build import build_dataset, file_ranks, long_observations, ranked_rows, wide_column_list
from fleetseries.plans.q_files import logger_headers, station_of
from fleetseries.plans.registry import register
from fleetseries.schemas import DIMS
from fleetseries.session import new_scratch_path, write_table


def deduped(spark, d):
    raw = fx.raw_rows(spark, d)
    return rec.dedup_keep_last(ranked_rows(raw, file_ranks(raw)))


def indexed_coverage(spark, d):
    """Time coverage as the stored file index has it."""
    return write_table(cov.time_coverage(rec.file_bounds(fx.raw_rows(spark, d))), "coverage")


def keylast_cells(spark, d):
    """(dataset_id, time, cells): the newest value of every key of a station and hour, in one grouping."""
    raw = fx.raw_rows(spark, d)
    newest = {k: F.max_by(F.when(F.col("event_type") == k, F.col("value").cast("string")),
                          F.when(F.col("event_type") == k, F.col("ts"))) for k in fx.EVENT_TYPES}
    rows = raw.groupBy("dataset_id", "time").agg(*[v.alias(k) for k, v in newest.items()])
    cells = F.create_map(*[x for k in fx.EVENT_TYPES for x in (F.lit(k), F.col(k))])
    return rows.select("dataset_id", "time", F.map_filter(cells, lambda k, v: v.isNotNull()).alias("cells"))


def keylast_long(spark, d):
    return fx.keep_last_per_key(spark, d).select("dataset_id", "time", "raw_name", "raw_value")


@register("alias_coalesce", f"""WITH {fx.KEYLAST_SQL}
SELECT dataset_id, time,
  CASE WHEN count(*) FILTER (WHERE raw_name = 'click') > 0 THEN 'click' ELSE 'view' END AS raw_name,
  coalesce(max(value) FILTER (WHERE raw_name = 'click'), max(value) FILTER (WHERE raw_name = 'view')) AS value_num
FROM keylast WHERE raw_name IN ('click', 'view') GROUP BY dataset_id, time""")
def alias_coalesce(spark, d):
    vmap = map_ops.variable_map_from_specs(spark, fx.EVENT_SPECS[:1])
    obs = map_ops.map_long(keylast_long(spark, d), vmap)
    return obs.select("dataset_id", "time", "raw_name", "value_num")


@register("map_variables", f"""WITH {fx.KEYLAST_SQL},
airt AS (
  SELECT dataset_id, time, 'air_temperature' AS canonical_name, 'degC' AS units,
    coalesce(max(value) FILTER (WHERE raw_name = 'click'), max(value) FILTER (WHERE raw_name = 'view')) AS value_num,
    CAST(NULL AS VARCHAR) AS value_str
  FROM keylast WHERE raw_name IN ('click', 'view') GROUP BY dataset_id, time)
SELECT * FROM airt
UNION ALL SELECT dataset_id, time, 'relative_humidity', '%', value, NULL FROM keylast WHERE raw_name = 'purchase'
UNION ALL SELECT dataset_id, time, 'signup', NULL, NULL, CAST(value AS VARCHAR) FROM keylast WHERE raw_name = 'signup'""")
def map_variables(spark, d):
    vmap = map_ops.variable_map_from_specs(spark, fx.EVENT_SPECS)
    obs = map_ops.map_long(keylast_long(spark, d), vmap)
    return obs.select("dataset_id", "time", "canonical_name", "units", "value_num", "value_str")


_STACK_MEMBERS_SQL = "(VALUES ('click', 30.0::DOUBLE, 0), ('view', 2.0::DOUBLE, 1), ('purchase', 10.0::DOUBLE, 2), " \
    "('absent_sensor', 50.0::DOUBLE, 3)) AS m(raw_name, height, dim_ord)"


@register("stack_dimension", f"""WITH {fx.KEYLAST_SQL},
present AS (SELECT DISTINCT dataset_id, time FROM keylast WHERE raw_name IN ('click', 'view', 'purchase'))
SELECT p.dataset_id, p.time, m.height, CAST(m.dim_ord AS INTEGER) AS dim_ord, k.value AS value_num
FROM present p CROSS JOIN {_STACK_MEMBERS_SQL}
LEFT JOIN keylast k ON k.dataset_id = p.dataset_id AND k.time = p.time AND k.raw_name = m.raw_name""")
def stack_dimension(spark, d):
    full = map_ops.stack_cells(keylast_cells(spark, d), fx.STACKED_SPECS[:1])
    return full.select("dataset_id", "time", F.col("dims")[0]["num"].alias("height"),
                       F.col("dim_ord")[0].cast("int").alias("dim_ord"), "value_num")


_TWO_DIM_SQL = "(VALUES ('click', 2.0::DOUBLE, 'ch1'), ('view', 2.0::DOUBLE, 'ch2'), ('purchase', 10.0::DOUBLE, 'ch1')) " \
    "AS m(raw_name, height, channel)"


@register("stack_two_dims", f"""WITH {fx.KEYLAST_SQL}
SELECT k.dataset_id, k.time, m.height, m.channel, k.value AS value_num
FROM keylast k JOIN {_TWO_DIM_SQL} ON k.raw_name = m.raw_name""")
def stack_two_dims(spark, d):
    vmap = map_ops.variable_map_from_specs(spark, fx.TWO_DIM_SPECS)
    obs = map_ops.map_long(keylast_long(spark, d), vmap)
    return obs.select("dataset_id", "time", F.col("dims")[0]["num"].alias("height"),
                      F.col("dims")[1]["txt"].alias("channel"), "value_num")


@register("dim_complete", f"""WITH {fx.KEYLAST_SQL},
present AS (SELECT DISTINCT dataset_id, time FROM keylast WHERE raw_name IN ('click', 'view', 'purchase')),
combos AS (SELECT * FROM (VALUES (2.0::DOUBLE), (10.0::DOUBLE)) h(height) CROSS JOIN (VALUES ('ch1'), ('ch2')) c(channel))
SELECT p.dataset_id, p.time, c.height, c.channel, k.value AS value_num
FROM present p CROSS JOIN combos c
LEFT JOIN {_TWO_DIM_SQL} ON m.height = c.height AND m.channel = c.channel
LEFT JOIN keylast k ON k.dataset_id = p.dataset_id AND k.time = p.time AND k.raw_name = m.raw_name""")
def dim_complete(spark, d):
    full = map_ops.stack_cells(keylast_cells(spark, d), fx.TWO_DIM_SPECS)
    return full.select("dataset_id", "time", F.col("dims")[0]["num"].alias("height"),
                       F.col("dims")[1]["txt"].alias("channel"), "value_num")


def _num_sql(expr: str, units: str) -> str:
    return (f"CASE WHEN {expr} = floor({expr}) THEN CAST(CAST({expr} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({expr} AS VARCHAR) END || '{units}'")


@register("wide_names", f"""SELECT p_type AS dataset_id, 'P' || p_partkey AS raw_name,
  'air_temperature_' || {_num_sql('CAST(p_size AS DOUBLE)', 'm')} || '_' || {_num_sql('p_retailprice', 'hPa')}
    || '_' || replace(trim(p_name), ' ', '_') AS column_name
FROM part""")
def wide_names(spark, d):
    p = fx.table(spark, d, "part")
    dims = F.array(
        F.struct(F.lit("height").alias("name"), F.lit("m").alias("units"),
                 F.col("p_size").cast("double").alias("num"), F.lit(None).cast("string").alias("txt")),
        F.struct(F.lit("pressure").alias("name"), F.lit("hPa").alias("units"),
                 F.col("p_retailprice").alias("num"), F.lit(None).cast("string").alias("txt")),
        F.struct(F.lit("statistic").alias("name"), F.lit(None).cast("string").alias("units"),
                 F.lit(None).cast("double").alias("num"), F.col("p_name").alias("txt")),
    ).cast(DIMS)
    vm = p.select(F.col("p_type").alias("dataset_id"),
                  F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("raw_name"),
                  F.lit("air_temperature").alias("canonical_name"), dims.alias("dims"))
    return exp.with_column_names(vm).select("dataset_id", "raw_name", F.col("column_name"))


def _wide_sql_cols() -> str:
    return """CASE WHEN event_type = 'click' THEN value END AS air_temperature_30m,
  CASE WHEN event_type = 'view' THEN value END AS air_temperature_2m,
  CASE WHEN event_type = 'purchase' THEN value END AS air_temperature_10m,
  CAST(NULL AS DOUBLE) AS air_temperature_50m,
  CASE WHEN event_type = 'error' THEN value END AS wind_speed,
  CASE WHEN event_type = 'signup' THEN CAST(value AS VARCHAR) END AS signup"""


WIDE_SQL = f"""{fx.DEDUP_SQL},
wide AS (SELECT dataset_id, time, {_wide_sql_cols()} FROM dedup)"""


def wide_frame(spark, d):
    vmap = map_ops.variable_map_from_specs(spark, fx.STACKED_SPECS)
    obs = long_observations(deduped(spark, d), vmap)
    return exp.to_wide(obs, wide_column_list(fx.STACKED_SPECS))


@register("wide_export", f"WITH {WIDE_SQL} SELECT * FROM wide")
def wide_export(spark, d):
    return wide_frame(spark, d)


_DEP_JOIN = "LEFT JOIN fdeps f ON f.dataset_id = d.dataset_id AND d.time >= f.start AND (f.end_ IS NULL OR d.time < f.end_)"

# the export of a build with fractions of a second and values that are no numbers
BAD_TEXT_MOD = 31
EXPORT_COLUMNS = ["air_temperature", "relative_humidity", "signup"]


def export_raw(spark, d):
    """Raw rows on the millisecond; every 31st value is a text, and the fraction is dropped for odd readings."""
    text = F.when(F.col("event_id") % BAD_TEXT_MOD == 0, F.concat(F.lit("bad "), (F.col("event_id") % 3).cast("string"))) \
        .otherwise(F.col("value").cast("string"))
    unit = F.when(F.col("event_id") % 2 == 0, F.date_trunc("millisecond", "ts") + F.expr("make_dt_interval(0, 0, 0, 0.25)")) \
        .otherwise(F.date_trunc("second", "ts"))
    raw = fx.raw_rows(spark, d)
    return raw.withColumn("time", unit.cast("timestamp_ntz")).withColumn("cells", F.create_map("event_type", text))


EXPORT_SQL = f"""{fx.FIXED_DEPS_SQL},
eraw AS (
  SELECT 'st' || user_id AS dataset_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS live, event_id, event_type,
    CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) + INTERVAL 250 MILLISECOND ELSE date_trunc('second', ts) END AS time,
    CASE WHEN event_id % {BAD_TEXT_MOD} = 0 THEN 'bad ' || (event_id % 3) ELSE CAST(value AS VARCHAR) END AS text,
    CASE WHEN event_id % {BAD_TEXT_MOD} = 0 THEN NULL ELSE value END AS num,
    'st' || user_id || CASE event_id % 3 WHEN 2 THEN '_Min.dat' WHEN 1 THEN '_Min_Historical.dat' ELSE '_Min.dat.backup' END AS file_name
  FROM events),
efiles AS (SELECT dataset_id, file_name, row_number() OVER (PARTITION BY dataset_id ORDER BY any_value(live), min(time), file_name) AS file_rank
           FROM eraw GROUP BY dataset_id, file_name),
elast AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.dataset_id, time ORDER BY file_rank DESC, event_id DESC) AS rn
                         FROM eraw r JOIN efiles USING (dataset_id, file_name)) WHERE rn = 1),
built AS (
  SELECT d.dataset_id, d.time, f.lat AS latitude, f.lon AS longitude,
    CASE WHEN event_type IN ('click', 'view') THEN num END AS air_temperature,
    CASE WHEN event_type = 'purchase' THEN num END AS relative_humidity,
    CASE WHEN event_type = 'signup' THEN text END AS signup,
    CASE WHEN num IS NULL AND event_type IN ('click', 'view') THEN 'air_temperature'
         WHEN num IS NULL AND event_type = 'purchase' THEN 'relative_humidity' END AS bad, text
  FROM elast d {_DEP_JOIN}),
warned AS (
  SELECT dataset_id, bad, count(*) AS n_bad, bad || ': ' || count(*) || ' value(s) could not be parsed as numeric and were set to NaN (examples: ['
    || array_to_string(list_transform(list_sort(list(DISTINCT text)), lambda x: chr(39) || x || chr(39)), ', ') || '])' AS warning
  FROM built WHERE bad IS NOT NULL GROUP BY dataset_id, bad),
eattrs AS (
  SELECT b.dataset_id, {{iso_min}} AS time_coverage_start, {{iso_max}} AS time_coverage_end,
    CAST(min(latitude) AS VARCHAR) AS geospatial_lat_min, CAST(max(latitude) AS VARCHAR) AS geospatial_lat_max,
    CAST(min(longitude) AS VARCHAR) AS geospatial_lon_min, CAST(max(longitude) AS VARCHAR) AS geospatial_lon_max,
    (SELECT string_agg(warning, '; ' ORDER BY bad) FROM warned w WHERE w.dataset_id = b.dataset_id) AS data_quality_warnings,
    'Station ' || b.dataset_id AS title
  FROM built b GROUP BY b.dataset_id)"""


def _iso_sql(t: str) -> str:
    return f"(strftime({t}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({t}) % 1000000 = 0 THEN '' ELSE strftime({t}, '.%f') END)"


EXPORT_SQL = EXPORT_SQL.replace("{iso_min}", _iso_sql("min(time)") + " || 'Z'").replace("{iso_max}", _iso_sql("max(time)") + " || 'Z'")
ATTR_NAMES = ["data_quality_warnings", "geospatial_lat_max", "geospatial_lat_min", "geospatial_lon_max", "geospatial_lon_min",
              "time_coverage_end", "time_coverage_start", "title"]


def exported(spark, d):
    """The build, written once with its bad values, the totals from one pass over it, and its attributes."""
    built = build_dataset(export_raw(spark, d), fx.EVENT_SPECS, fx.deployments(spark, d, "fixed"), "fixed", report_bad=True)
    built = write_table(built, "built")
    totals = write_table(cov.side_totals(built), "built_totals")
    given = totals.select("dataset_id").distinct().select("dataset_id", F.create_map(
        F.lit("title"), F.concat(F.lit("Station "), F.col("dataset_id"))).alias("attrs"))
    return built, totals, cov.build_attrs(totals, map_ops.wide_columns(fx.EVENT_SPECS), given)


@register("build_attrs", f"WITH {EXPORT_SQL} SELECT dataset_id, {', '.join(ATTR_NAMES)} FROM eattrs")
def build_attrs(spark, d):
    _, _, attrs = exported(spark, d)
    return attrs.select("dataset_id", *[F.element_at("attrs", F.lit(n)).alias(n) for n in ATTR_NAMES])


@register("variable_attrs", f"""WITH {EXPORT_SQL},
v AS (SELECT * FROM (VALUES ('air_temperature', 'air_temperature', 'degC', 'numeric'), ('relative_humidity', 'relative_humidity', '%', 'numeric'),
      ('signup', NULL, NULL, 'string')) AS v(canonical_name, standard_name, units, dtype))
SELECT s.dataset_id, v.canonical_name, v.standard_name, v.units, v.dtype, 'degC' AS logger_units, 'Avg' AS agg_types,
  coalesce(w.n_bad, 0) AS n_bad
FROM (SELECT DISTINCT dataset_id FROM built) s CROSS JOIN v
LEFT JOIN warned w ON w.dataset_id = s.dataset_id AND w.bad = v.canonical_name""")
def variable_attrs(spark, d):
    _, totals, _ = exported(spark, d)
    headers = logger_headers(spark, d).filter("valid").withColumn("dataset_id", station_of(F.col("file_name")))
    return cov.variable_attrs(map_ops.variable_map_from_specs(spark, fx.EVENT_SPECS), headers, totals)


def _csv_time_sql(t: str) -> str:
    return (f"(strftime({t}, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond({t}) % 1000000 = 0 THEN '' "
            f"WHEN microsecond({t}) % 1000 = 0 THEN strftime({t}, '.%g') ELSE strftime({t}, '.%f') END)")


_CELLS_SQL = " || ',' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in EXPORT_COLUMNS)


@register("csv_export", f"""WITH {EXPORT_SQL}
{" UNION ALL ".join(f"SELECT dataset_id, 0 AS section, '# {n}: ' || {n} AS line FROM eattrs WHERE {n} IS NOT NULL" for n in ATTR_NAMES)}
UNION ALL SELECT dataset_id, 1, '#' FROM eattrs
UNION ALL SELECT dataset_id, 2, 'time,{",".join(EXPORT_COLUMNS)}' FROM eattrs
UNION ALL SELECT dataset_id, 3, {_csv_time_sql("time")} || ',' || {_CELLS_SQL} FROM built""")
def csv_export(spark, d):
    built, _, attrs = exported(spark, d)
    return exp.csv_lines(built, attrs, EXPORT_COLUMNS).select("dataset_id", "section", "line")


@register("csv_documents", f"""WITH {EXPORT_SQL},
doc AS (SELECT dataset_id, strftime(time, '%Y-%m') AS chunk, string_agg({_csv_time_sql("time")} || ',' || {_CELLS_SQL} || chr(10), '' ORDER BY time) AS body
        FROM built GROUP BY dataset_id, strftime(time, '%Y-%m'))
SELECT doc.dataset_id, chunk, length(
  {" || ".join(f"coalesce('# {n}: ' || {n} || chr(10), '')" for n in ATTR_NAMES)} || '#' || chr(10) || 'time,{",".join(EXPORT_COLUMNS)}' || chr(10) || body) AS n_chars,
  md5({" || ".join(f"coalesce('# {n}: ' || {n} || chr(10), '')" for n in ATTR_NAMES)} || '#' || chr(10) || 'time,{",".join(EXPORT_COLUMNS)}' || chr(10) || body) AS digest
FROM doc JOIN eattrs USING (dataset_id)""")
def csv_documents(spark, d):
    """Documents written in parts of few rows and read back: the parts of a document, in order, are the document."""
    built, _, attrs = exported(spark, d)
    path = new_scratch_path(spark, "csv_documents")
    exp.write_csv_documents(exp.csv_lines(built, attrs, EXPORT_COLUMNS), path, part_rows=16)
    whole = exp.read_csv_documents(spark, path).groupBy("dataset_id", "chunk").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.select("dataset_id", "chunk", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@register("json_columns", f"""WITH {EXPORT_SQL}
SELECT dataset_id, date_trunc('day', time) AS chunk, CAST(0 AS INTEGER) AS part,
  CAST(to_json({{'time': list({_iso_sql("time")} ORDER BY time),
    {", ".join(f"'{c}': list({c} ORDER BY time)" for c in EXPORT_COLUMNS)}}}) AS VARCHAR) AS json
FROM built GROUP BY dataset_id, date_trunc('day', time)""")
def json_columns(spark, d):
    built, _, _ = exported(spark, d)
    return exp.json_columns(built, EXPORT_COLUMNS)


@register("deployment_fixed", f"""WITH {fx.DEDUP_SQL}, {fx.FIXED_DEPS_SQL}
SELECT d.dataset_id, d.time, f.lat AS latitude, f.lon AS longitude, f.elevation AS elevation
FROM dedup d {_DEP_JOIN}""")
def deployment_fixed(spark, d):
    obs = deduped(spark, d).select("dataset_id", "time")
    return dep_ops.attach_deployments(obs, fx.deployments(spark, d, "fixed"), "fixed")


@register("deployment_mobile", f"""WITH {fx.DEDUP_SQL}, {fx.MOBILE_DEPS_SQL}
SELECT d.dataset_id, d.time, f.platform_name AS platform
FROM dedup d LEFT JOIN mdeps f ON f.dataset_id = d.dataset_id AND d.time >= f.start
  AND (f.end_ IS NULL OR d.time < f.end_)""")
def deployment_mobile(spark, d):
    obs = deduped(spark, d).select("dataset_id", "time")
    return dep_ops.attach_deployments(obs, fx.deployments(spark, d, "mobile"), "mobile")


@register("deployment_asof", f"""WITH {fx.DEDUP_SQL}, {fx.FIXED_DEPS_SQL}
SELECT d.dataset_id, d.time, f.lat AS latitude, f.lon AS longitude, f.elevation AS elevation,
  CAST(f.dep_ord AS INTEGER) AS dep_ord
FROM dedup d {_DEP_JOIN}""")
def deployment_asof(spark, d):
    obs = deduped(spark, d).select("dataset_id", "time")
    return dep_ops.attach_deployments_bucketed(obs, fx.deployments(spark, d, "fixed"), indexed_coverage(spark, d),
                                               "fixed", keep_dep_ord=True)


NOW_POS = "2024-01-15 18:00:00"


@register("current_position", f"""WITH {fx.FIXED_DEPS_SQL},
a AS (SELECT *, start <= TIMESTAMP '{NOW_POS}' AND (end_ IS NULL OR end_ > TIMESTAMP '{NOW_POS}') AS active
      FROM fdeps)
SELECT dataset_id, CAST(dep_ord AS INTEGER) AS dep_ord, active, lat, lon, elevation FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY active DESC,
         CASE WHEN active THEN dep_ord ELSE -dep_ord END) AS rn FROM a) WHERE rn = 1""")
def current_position(spark, d):
    return dep_ops.current_position(fx.deployments(spark, d, "fixed"), NOW_POS)


@register("coverage_attrs", f"""WITH {fx.DEDUP_SQL}, {fx.FIXED_DEPS_SQL}
SELECT d.dataset_id, strftime(min(d.time), '%Y-%m-%dT%H:%M:%S') || 'Z' AS time_coverage_start,
  strftime(max(d.time), '%Y-%m-%dT%H:%M:%S') || 'Z' AS time_coverage_end,
  min(f.lat) AS geospatial_lat_min, max(f.lat) AS geospatial_lat_max,
  min(f.lon) AS geospatial_lon_min, max(f.lon) AS geospatial_lon_max
FROM dedup d {_DEP_JOIN} GROUP BY d.dataset_id""")
def coverage_attrs(spark, d):
    obs = deduped(spark, d).select("dataset_id", "time")
    built = dep_ops.attach_deployments(obs, fx.deployments(spark, d, "fixed"), "fixed")
    return cov.coverage_attrs(built)

