"""Catalog, rules, versions and attribute queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseries.operators import catalog as cat
from fleetseries.operators import coverage as cov
from fleetseries.operators import deployment as dep_ops
from fleetseries.operators import rules
from fleetseries.plans import fixtures as fx
from fleetseries.plans.build import catalog_deployments
from fleetseries.plans.q_files import fixture_root
from fleetseries.plans.registry import register
from fleetseries.schemas import MESSAGES as M
from fleetseries.session import path_exists, scratch_path
from fleetseries.sources import catalog_docs
from fleetseries.sources.named_files import write_files


def _documents(spark, d):
    return fx.catalog_documents(spark, d).select("dataset_id", "content"), scratch_path(spark, "catalog")


def stored_catalog(spark, d):
    """Catalog and findings, parsed and checked once per state of the documents."""
    return rules.checked_catalog(*_documents(spark, d))


def parsed_catalog(spark, d):
    """The catalog alone, for what computes its own findings."""
    return rules.parsed_catalog(*_documents(spark, d))[0]


def valid_catalog(spark, d):
    """Parsed documents without any rule violation (what listings may show)."""
    return rules.valid_configs(*stored_catalog(spark, d))


VALID_SQL = f"""{fx.CATALOG_SQL},
valid AS (SELECT * FROM cat WHERE NOT {fx.VIOLATION_SQL}),
vis AS (SELECT * FROM valid WHERE access = 'public')"""


IN_FOLDER = f"({fx.BROKEN} OR c_custkey % 20 = 0)"  # one file each; the others are lines of a dump


def config_files(spark, d):
    """The documents as files in the shared folder: a folder of one document each, and a dump of one per line."""
    folder, dump = (fixture_root(spark, n, d) for n in ("config_folder", "config_dump"))
    if not path_exists(spark, dump + "/_SUCCESS"):
        docs = fx.catalog_documents(spark, d).withColumn("in_folder", F.expr(IN_FOLDER))
        single = docs.filter("in_folder").select(F.concat("dataset_id", F.lit(".json")).alias("path"), F.col("content").alias("line"))
        write_files(single, folder)
        docs.filter("not in_folder").select("content").write.mode("overwrite").text(dump)
    return folder, dump


@register("catalog_load", f"""WITH {fx.CATALOG_SQL}
SELECT CASE WHEN {IN_FOLDER} THEN 'folder' ELSE 'devices' END AS source_id, dataset_id, access, platform_type, source_type,
  title, publish FROM cat WHERE parsed_ok""")
def catalog_load(spark, d):
    folder, dump = config_files(spark, d)
    docs = catalog_docs.union_sources([
        catalog_docs.read_config_dir(spark, folder, "folder"), catalog_docs.read_config_lines(spark, dump, "devices")])
    c = cat.parse_documents(docs).filter("parsed_ok")
    return c.select("source_id", "dataset_id", "access", "platform_type", "source_type",
                    F.col("metadata")["title"].alias("title"), "publish")


@register("catalog_visible", f"WITH {VALID_SQL} SELECT dataset_id, title FROM vis")
def catalog_visible(spark, d):
    v = cat.visible(valid_catalog(spark, d))
    return v.select("dataset_id", F.col("metadata")["title"].alias("title"))


def _docs(spark, d):
    return cat.search_documents(cat.visible(valid_catalog(spark, d)))


Q = "america"


@register("catalog_search", f"""WITH {VALID_SQL}
SELECT dataset_id, title FROM vis
WHERE contains(lower(dataset_id || ' ' || title || ' ' || institution || ' CF-1.10 ' || country || ' ' || department),
               '{Q}')""")
def catalog_search(spark, d):
    out = cat.match_text(_docs(spark, d), Q)
    return out.select("dataset_id", F.col("metadata")["title"].alias("title")).orderBy("dataset_id")


@register("listing_total", f"""WITH {VALID_SQL}
SELECT count(*) AS total FROM vis
WHERE contains(lower(dataset_id || ' ' || title || ' ' || institution || ' CF-1.10 ' || country || ' ' || department),
               '{Q}')""")
def listing_total(spark, d):
    return cat.match_text(_docs(spark, d), Q).agg(F.count(F.lit(1)).alias("total"))


@register("catalog_platform", f"WITH {VALID_SQL} SELECT dataset_id, title FROM vis WHERE platform_type = 'mobile'")
def catalog_platform(spark, d):
    out = cat.match_platform(_docs(spark, d), "mobile")
    return out.select("dataset_id", F.col("metadata")["title"].alias("title"))


HAS_ALL = ["air_temperature", "relative_humidity"]


@register("catalog_has_all", f"""WITH {VALID_SQL}
SELECT dataset_id, title FROM vis WHERE list_has_all(standard_names, ['air_temperature', 'relative_humidity'])""")
def catalog_has_all(spark, d):
    out = cat.match_all_names(_docs(spark, d), HAS_ALL)
    return out.select("dataset_id", F.col("metadata")["title"].alias("title"))


META = [("department", "build"), ("institution", "EUR")]


@register("catalog_meta", f"""WITH {VALID_SQL}
SELECT dataset_id, title FROM vis
WHERE contains(lower(department), 'build') AND contains(lower(institution), 'eur')""")
def catalog_meta(spark, d):
    out = cat.match_metadata(_docs(spark, d), META)
    return out.select("dataset_id", F.col("metadata")["title"].alias("title"))


@register("facet_names", f"WITH {VALID_SQL} SELECT DISTINCT unnest(standard_names) AS standard_name FROM vis")
def facet_names(spark, d):
    return cat.facet_names(_docs(spark, d))


@register("facet_keys", f"""WITH {VALID_SQL}
SELECT DISTINCT unnest(['title', 'institution', 'department', 'country', 'standard_name_vocabulary']) AS metadata_key
FROM vis""")
def facet_keys(spark, d):
    return cat.facet_keys(_docs(spark, d))


NOW_CAT = "2021-09-01 00:00:00"


@register("dataset_summary", f"""WITH {VALID_SQL}
SELECT dataset_id, title, institution, platform_type, array_to_string(standard_names, ',') AS standard_names,
  'country=' || country || ';department=' || department || ';institution=' || institution || ';standard_name_vocabulary=CF-1.10;title='
    || title AS metadata_text,
  CASE WHEN platform_type = 'fixed' THEN CAST(60 + c_nationkey AS DOUBLE) END AS lat,
  CASE WHEN platform_type = 'fixed' THEN CAST(c_nationkey * 2 AS DOUBLE) END AS lon,
  CAST(NULL AS DOUBLE) AS elevation
FROM vis""")
def dataset_summary(spark, d):
    v = cat.visible(valid_catalog(spark, d))
    pos = dep_ops.current_position(catalog_deployments(v.filter(F.col("platform_type") == "fixed")), NOW_CAT)
    out = cov.attrs_text(cat.dataset_summaries(v, pos), "metadata")
    return out.withColumn("standard_names", F.array_join("standard_names", ",")).drop("metadata")


_VARNAMES = {
    "BUILDING": "air_temperature,relative_humidity",
    "AUTOMOBILE": "wind_speed,latitude,longitude",
    "MACHINERY": "air_pressure,status",
    "HOUSEHOLD": "air_temperature,air_temperature",
    "FURNITURE": "sea_surface_temperature",
}


_UNITS = {"BUILDING": "degC,%", "AUTOMOBILE": "m/s,degrees_north,degrees_east", "MACHINERY": "mbar,-", "HOUSEHOLD": "degC,degC", "FURNITURE": "degC"}
_RAW = {"BUILDING": "AirT_C,RH", "AUTOMOBILE": "WS_ms,Lat,Lon", "MACHINERY": "BP_mbar,status", "HOUSEHOLD": "AirT_C,T2+T10", "FURNITURE": "SST_Avg"}


@register("dataset_detail", f"""WITH {VALID_SQL}, {fx.ORDER_COVERAGE_SQL}
SELECT v.dataset_id, title, source_type, {fx._case_sql({k: f"'{v}'" for k, v in _VARNAMES.items()}, 'department')} AS variable_names,
  {fx._case_sql({k: f"'{v}'" for k, v in _UNITS.items()}, 'department')} AS units,
  {fx._case_sql({k: f"'{v}'" for k, v in _RAW.items()}, 'department')} AS raw_names,
  CASE WHEN platform_type = 'fixed' THEN '2020-01-01T00:00:00,2022-01-01T00:00:00' ELSE '2020-01-01T00:00:00' END AS starts,
  data_start, data_end
FROM vis v LEFT JOIN cov c ON c.dataset_id = v.dataset_id""")
def dataset_detail(spark, d):
    out = cat.dataset_details(cat.visible(valid_catalog(spark, d)), fx.order_coverage(spark, d))

    def joined(field):
        return F.array_join(F.transform("variables", lambda v: F.coalesce(v[field], F.lit("-"))), ",")

    raw = F.array_join(F.transform("variables", lambda v: F.array_join(v["raw_names"], "+")), ",")
    return out.select("dataset_id", F.element_at("metadata", "title").alias("title"), "source_type", joined("name").alias("variable_names"),
                      joined("units").alias("units"), raw.alias("raw_names"),
                      F.array_join(F.transform("deployments", lambda x: x["start"]), ",").alias("starts"), "data_start", "data_end")


@register("config_hash", f"WITH {fx.VERSIONS_SQL} SELECT dataset_id, version_id, sha256(content) AS hash FROM versions")
def config_hash(spark, d):
    return cat.config_hash(fx.order_versions(spark, d)).select("dataset_id", "version_id", "hash")


# the same documents with keys in another order, numbers in another form and blanks for odd orders
_LIMITS = ('{"b": [1.50, 2], "a": {"y": 3.0, "x": null}}', '{"a":{"x":null,"y":3},"b":[1.5,2.0]}')


@register("config_hash_sorted", """SELECT 'cust' || o_custkey AS dataset_id, o_orderkey AS version_id,
  sha256('{"id":"cust' || o_custkey || '","limits":{"a":{"x":null,"y":3},"b":[1.5,2]},"priority":"' || o_orderpriority
    || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def config_hash_sorted(spark, d):
    """One hash for a document and its re-ordered writing (device attributes come as objects, not as bytes)."""
    o = fx.table(spark, d, "orders")
    fields = {"id": F.concat(F.lit("cust"), F.col("o_custkey").cast("string")), "status": F.col("o_orderstatus"),
              "priority": F.col("o_orderpriority")}
    pairs = {k: F.concat(F.lit(f'"{k}":"'), v, F.lit('"')) for k, v in fields.items()}
    odd = F.concat(F.lit("{ "), F.concat_ws(" ,\n", pairs["status"], F.lit(f'"limits": {_LIMITS[0]}'), pairs["id"], pairs["priority"]), F.lit("}"))
    even = F.concat(F.lit("{"), F.concat_ws(",", pairs["priority"], pairs["id"], F.lit(f'"limits":{_LIMITS[1]}'), pairs["status"]), F.lit("}"))
    content = F.when(F.col("o_orderkey") % 2 == 1, odd).otherwise(even)
    docs = o.select(fields["id"].alias("dataset_id"), F.col("o_orderkey").alias("version_id"), content.alias("content"))
    return cat.config_hash_sorted(docs).select("dataset_id", "version_id", "hash")


CURRENT_SQL = f"""{fx.VERSIONS_SQL},
cur AS (SELECT dataset_id, version_id, sha256(content) AS hash, content, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, version_id DESC) AS rn
  FROM versions) WHERE rn = 1)"""


def current_versions(spark, d):
    return cat.current_version(cat.config_hash(fx.order_versions(spark, d)))


@register("config_current", f"WITH {CURRENT_SQL} SELECT dataset_id, version_id, hash, created_at FROM cur")
def config_current(spark, d):
    return current_versions(spark, d).select("dataset_id", "version_id", "hash", "created_at")


@register("config_changes", f"""WITH {CURRENT_SQL},
incoming AS (
  SELECT 'cust' || c_custkey AS dataset_id,
    CASE WHEN c_custkey % 3 = 0 AND cur.content IS NOT NULL THEN cur.content
         ELSE '{{"id":"cust' || c_custkey || '","segment":"' || c_mktsegment || '"}}' END AS content
  FROM customer LEFT JOIN cur ON cur.dataset_id = 'cust' || c_custkey)
SELECT i.dataset_id, sha256(i.content) AS hash, cur.version_id IS NULL AS is_first
FROM incoming i LEFT JOIN cur USING (dataset_id)
WHERE cur.hash IS DISTINCT FROM sha256(i.content)""")
def config_changes(spark, d):
    cur = current_versions(spark, d)
    c = fx.table(spark, d, "customer")
    ds = F.concat(F.lit("cust"), F.col("c_custkey").cast("string"))
    inc = c.select(ds.alias("dataset_id"), "c_custkey", "c_mktsegment").join(
        cur.select("dataset_id", F.col("content").alias("cur_content")), "dataset_id", "left")
    content = F.when((F.col("c_custkey") % 3 == 0) & F.col("cur_content").isNotNull(), F.col("cur_content")) \
        .otherwise(F.concat(F.lit('{"id":"'), F.col("dataset_id"), F.lit('","segment":"'),
                            F.col("c_mktsegment"), F.lit('"}')))
    incoming = cat.config_hash(inc.select("dataset_id", content.alias("content")))
    out = cat.config_changes(cur, incoming, "2024-02-01 00:00:00")
    return out.select("dataset_id", "hash", "is_first")


@register("global_attrs", f"""WITH {VALID_SQL}
SELECT dataset_id, 'country=' || country || ';dataset_id=' || dataset_id || ';department=' || department
  || ';institution=' || institution || ';platform_type=' || platform_type || ';source_type=' || source_type
  || ';standard_name_vocabulary=CF-1.10;title=' || title AS attrs_text
FROM valid""")
def global_attrs(spark, d):
    out = cov.attrs_text(cov.global_attrs(valid_catalog(spark, d)))
    return out.select("dataset_id", "attrs_text")


GENERATED_AT = "2024-02-01 00:00:00"


@register("provenance", f"""WITH {CURRENT_SQL}
SELECT dataset_id, '0.1.0' AS processing_software_version, hash AS config_hash,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS config_version_timestamp,
  '2024-02-01T00:00:00Z: generated by fleetseries 0.1.0 for dataset ''' || dataset_id
    || ''' using config version ' || substr(hash, 1, 12) AS history
FROM cur""")
def provenance(spark, d):
    return cov.provenance(current_versions(spark, d), GENERATED_AT)


# --- rules -------------------------------------------------------------------

_COLLISION_SQL = "'" + M["raw_collision"].replace("'", "''").replace("%s", "dup_a").replace(
    "%d", "' || i || '", 1).replace("%d", "' || (i + 1) || '", 1) + "'"

def _rule_sql(body: str) -> str:
    return f"WITH {fx.CATALOG_SQL} {body}"


_N_SEG = fx._case_sql({k: str(v) for k, v in fx.SEGMENT_N_VARS.items()}, "department")


def _found(rule: str, found: list[tuple[str, str, str]]) -> str:
    """SQL of the findings that the injected problems cause: (problem, location, message) rows of one rule."""
    rows = [f"SELECT dataset_id, '{rule}' AS rule, '{where}' AS location, '{message}' AS message FROM cat "
            f"WHERE parsed_ok AND {fx.PROBLEMS[problem]}" for problem, where, message in found]
    return " UNION ALL ".join(rows)


@register("rule_schema", _rule_sql(f"""
SELECT dataset_id, 'schema' AS rule, 'document' AS location, 'invalid JSON' AS message FROM cat WHERE NOT parsed_ok
UNION ALL """ + _found("schema", [
    ("unknown_key", "document", "unknown keys: colour"),
    ("bad_date", "deployments[0].end", "end must be a time, got soon"),
    ("bad_elevation", "deployments[1].elevation", "elevation must be a number, got high"),
    ("no_title", "metadata", "missing fields: title"),
    ("bad_access", "access", "access must be one of public|restricted, got secret"),
    ("bad_publish", "output.publish", "publish must be true or false, got maybe"),
    ("bad_license", "metadata.license", "license must be text, got 12"),
])))
def rule_schema(spark, d):
    return rules.rule_schema(parsed_catalog(spark, d))


@register("rule_variable_shape", _rule_sql(f"""
SELECT dataset_id, 'variable_shape' AS rule, 'variables[' || ({_N_SEG}) || ']' AS location,
  '{M['both_shapes']}' AS message
FROM cat WHERE parsed_ok AND {fx.PROBLEMS['both_shapes']}
UNION ALL
SELECT dataset_id, 'member_arity', 'variables[' || ({_N_SEG} + CASE WHEN {fx.PROBLEMS['both_shapes']}
  THEN 1 ELSE 0 END) || '].members[0]', '{M['list_value'] % 2}'
FROM cat WHERE parsed_ok AND {fx.PROBLEMS['arity']}"""))
def rule_variable_shape(spark, d):
    return rules.rule_variable_shape(parsed_catalog(spark, d))


@register("rule_name_collision", _rule_sql(f"""
SELECT dataset_id, 'name_collision' AS rule, 'raw_name:dup_a' AS location,
  {_COLLISION_SQL} AS message
FROM (SELECT *, {_N_SEG} + CASE WHEN {fx.PROBLEMS['both_shapes']} THEN 1 ELSE 0 END
        + CASE WHEN {fx.PROBLEMS['arity']} THEN 1 ELSE 0 END AS i FROM cat)
WHERE parsed_ok AND {fx.PROBLEMS['collision']}"""))
def rule_name_collision(spark, d):
    return rules.rule_name_collision(parsed_catalog(spark, d))


@register("rule_deployments", _rule_sql(_found("deployments", [
    ("end_before", "deployments[0]", M["end_before_start"]), ("open_first", "deployments[0]", M["open_not_last"])])))
def rule_deployments(spark, d):
    return rules.rule_deployments(parsed_catalog(spark, d))


@register("rule_overlap", _rule_sql(_found("overlap", [
    ("overlap", "deployments[0]", M["overlap"] % (0, 1)), ("unsorted", "deployments[0]", M["unsorted"])])))
def rule_overlap(spark, d):
    return rules.rule_overlap(parsed_catalog(spark, d))


@register("rule_platform", _rule_sql(_found("platform", [
    ("mobile_position", "deployments[0]", M["fixed_only_fields"]), ("mobile_unnamed", "deployments[0]", M["mobile_needs_platform"]),
    ("mobile_names", "variables", M["mobile_needs_names"] % "latitude,longitude"),
    ("no_position", "deployments[0]", M["fixed_needs_position"]), ("fixed_named", "deployments[0]", M["mobile_only_fields"])])))
def rule_platform(spark, d):
    return rules.rule_platform(parsed_catalog(spark, d))


@register("validate_source", _rule_sql(f"""
SELECT CASE WHEN parsed_ok AND source_type <> 'thingsboard' THEN 'skipped' WHEN {fx.VIOLATION_SQL} THEN 'invalid' ELSE 'valid' END
  AS status, count(*) AS n_configs FROM cat GROUP BY 1"""))
def validate_source(spark, d):
    """The verdicts of one source type; documents of the others are skipped."""
    return rules.validate_summary(rules.validate_verdicts(*stored_catalog(spark, d), only_source="thingsboard"))


@register("validate_summary", _rule_sql(f"""
SELECT CASE WHEN {fx.VIOLATION_SQL} THEN 'invalid' ELSE 'valid' END AS status, count(*) AS n_configs
FROM cat GROUP BY 1"""))
def validate_summary(spark, d):
    return rules.validate_summary(rules.validate_verdicts(*stored_catalog(spark, d)))
