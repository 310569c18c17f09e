"""Config validation as one table job: catalog -> (dataset_id, rule, location, message).

Every rule is a check *within* one config document: fields and types by the
schema walk, the others in a single projection with higher-order array
functions over the document's own ``variables`` / ``members`` / ``deployments``
arrays. No shuffle, no window; the findings array is exploded once. The verdict
per config is an anti-join / count of the findings.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.operators.catalog import parse_documents
from fleetseries.operators.schema_walk import schema_findings
from fleetseries.schemas import MESSAGES as M
from fleetseries.schemas import SOURCE_TYPES
from fleetseries.session import let
from fleetseries.sources.state import ConcurrentUpdate, StateTable

RULE_COLUMNS = ["dataset_id", "rule", "location", "message"]
#: Documents that one task parses and checks: their cost is in their rules, far above that of their bytes.
DOCS_PER_TASK = 5000
_FINDINGS_TYPE = "array<struct<rule:string,location:string,message:string>>"


def _f(cond: Column, rule: str, location: Column | str, message: Column | str) -> Column:
    loc = F.lit(location) if isinstance(location, str) else location
    msg = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), loc.alias("location"), msg.alias("message")))


def _arr(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _ts(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def _n_dims(ext: Column) -> Column:
    return F.when(ext.isNull(), F.lit(None).cast("int")).when(
        F.startswith(F.ltrim(ext), F.lit("[")), F.json_array_length(ext)).otherwise(F.lit(1))


# Findings expressions reference columns by name only, so one Column tree serves
# every DataFrame of a session (building it costs thousands of py4j calls).
_FINDINGS: WeakKeyDictionary[SparkSession, dict[tuple[str, ...], Column]] = WeakKeyDictionary()
RULES = ("deployments", "platform", "variable_shape", "member_arity", "name_collision", "overlap")


def findings_column(spark: SparkSession, names: tuple[str, ...] = RULES) -> Column:
    """The findings of the named rules on one config document, as an array of structs.

    The rules of the schema walk are not among them. Only the checks of the named rules are computed.
    """
    known = _FINDINGS.setdefault(spark, {})
    if names not in known:
        parts = [
            _document_findings(names) if {"deployments", "platform"} & set(names) else None,
            _shape_findings() if {"variable_shape", "member_arity"} & set(names) else None,
            _collision_findings() if "name_collision" in names else None,
            _deployment_findings(names) if {"deployments", "platform", "overlap"} & set(names) else None,
        ]
        known[names] = F.concat(*[p for p in parts if p is not None])
    return known[names]


def _of(names: tuple[str, ...], checks: list[tuple[Column, str, Column | str, Column | str]]) -> Column:
    """The findings of those checks (condition, rule, location, message) whose rule is named."""
    return _arr(*[_f(*check) for check in checks if check[1] in names])


def _document_findings(names: tuple[str, ...]) -> Column:
    ok = F.col("parsed_ok")
    standard = F.filter(F.transform(F.coalesce("variables", F.array()), lambda v: v["standard_name"]),
                        lambda s: s.isNotNull())
    miss_pos = F.array_sort(F.array_except(F.array(F.lit("latitude"), F.lit("longitude")), standard))
    return _of(names, [
        (ok & (F.coalesce(F.size("deployments"), F.lit(-1)) <= 0), "deployments", "deployments",
         M["no_deployment"]),
        (ok & (F.col("platform_type") == "mobile") & (F.size(miss_pos) > 0), "platform", "variables",
         F.format_string(M["mobile_needs_names"], F.array_join(miss_pos, ","))),
    ])


def _shape_findings() -> Column:
    """Shape and arity per variable."""
    variables = F.coalesce(F.col("variables"), F.array())

    counted = F.transform(variables, lambda v: F.struct(v.alias("v"), _n_dims(v["extra_dimension"]).alias("n_dims")))

    def per_var(c: Column, i: Column) -> Column:
        v, n_dims = c["v"], c["n_dims"]
        loc = F.format_string("variables[%d]", i)
        has_raw = v["raw_name"].isNotNull()
        has_dims = v["extra_dimension"].isNotNull()
        n_members = F.coalesce(F.size(v["members"]), F.lit(0))
        dims_var = has_dims & ~has_raw
        shape = _arr(
            _f(has_raw & has_dims, "variable_shape", loc, M["both_shapes"]),
            _f(~has_raw & ~has_dims, "variable_shape", loc,
               M["no_shape"]),
            _f(dims_var & (n_dims == 0), "variable_shape", loc,
               M["no_dimension"]),
            _f(dims_var & (n_dims > 0) & (n_members == 0), "variable_shape", loc,
               M["no_member"]),
            _f(dims_var & (n_dims > 0) & (n_members > 0) & v["standard_name"].isNull(), "variable_shape", loc,
               M["no_standard_name"]),
        )
        arity_ok_scope = dims_var & (n_dims > 0) & v["standard_name"].isNotNull()

        def per_member(m: Column, j: Column) -> Column:
            val = m["dimension_value"]
            is_list = F.startswith(F.ltrim(val), F.lit("["))
            bad = ((n_dims == 1) & is_list) | ((n_dims > 1) & (~is_list | (F.json_array_length(val) != n_dims)))
            return _f(arity_ok_scope & bad, "member_arity",
                      F.format_string("variables[%d].members[%d]", i, j),
                      F.when(n_dims == 1, F.lit(M["scalar_value"])).otherwise(
                          F.format_string(M["list_value"], n_dims)))

        arity = F.filter(F.transform(F.coalesce(v["members"], F.array()), per_member), lambda x: x.isNotNull())
        return F.concat(shape, arity)

    return F.when(F.col("parsed_ok"), F.flatten(F.transform(counted, per_var))).otherwise(F.array().cast(_FINDINGS_TYPE))


def _collision_findings() -> Column:
    """Raw names that a document maps more than once."""
    variables = F.coalesce(F.col("variables"), F.array())

    # raw names with their variable index: raw_name + old_names, or members
    def names_of(v: Column, i: Column) -> Column:
        names = F.when(v["extra_dimension"].isNotNull(),
                       F.transform(F.coalesce(v["members"], F.array()), lambda m: m["raw_name"])) \
            .otherwise(F.concat(F.array(v["raw_name"]), F.coalesce(v["old_names"], F.array().cast("array<string>"))))
        return F.transform(F.filter(names, lambda n: n.isNotNull()),
                           lambda n: F.struct(n.alias("n"), i.alias("i")))

    tagged = F.flatten(F.transform(variables, names_of))

    def collision(own: Column, name: Column) -> Column:
        return F.when(F.size(own) > 1, F.struct(
            F.lit("name_collision").alias("rule"), F.concat(F.lit("raw_name:"), name).alias("location"),
            F.format_string(M["raw_collision"], name, own[0]["i"], own[1]["i"]).alias("message")))

    def collided(tags: Column) -> Column:
        return F.filter(F.transform(
            F.array_distinct(F.transform(tags, lambda t: t["n"])),
            lambda name: let(F.filter(tags, lambda t: t["n"] == name), lambda own: collision(own, name)),
        ), lambda x: x.isNotNull())

    return F.when(F.col("parsed_ok"), let(tagged, collided)).otherwise(F.array().cast(_FINDINGS_TYPE))


def _deployment_findings(names: tuple[str, ...]) -> Column:
    ok = F.col("parsed_ok")
    deps = F.coalesce(F.col("deployments"), F.array())
    n = F.size(deps)
    # each deployment with the next deployment's start
    zipped = F.arrays_zip(deps.alias("d"), F.slice(F.transform(deps, lambda x: x["start"]), F.lit(2), F.size(deps)).alias("next_start"))
    read = F.transform(zipped, lambda z: F.struct(
        z["d"].alias("d"), _ts(z["d"]["start"]).alias("start"), _ts(z["d"]["end"]).alias("end"), _ts(z["next_start"]).alias("next_start")))
    fixed = F.col("platform_type") == "fixed"
    mobile = F.col("platform_type") == "mobile"

    def per_dep(z: Column, k: Column) -> Column:
        d, start, end, nstart = z["d"], z["start"], z["end"], z["next_start"]
        loc = F.format_string("deployments[%d]", k)
        return _of(names, [
            (end.isNotNull() & (end <= start), "deployments", loc, M["end_before_start"]),
            (d["end"].isNull() & (k < n - 1), "deployments", loc, M["open_not_last"]),
            (nstart.isNotNull() & (start > nstart), "overlap", loc, M["unsorted"]),
            (nstart.isNotNull() & end.isNotNull() & (start <= nstart) & (end > nstart), "overlap", loc,
               F.format_string(M["overlap"], k, k + 1)),
            (fixed & (d["lat"].isNull() | d["lon"].isNull()), "platform", loc,
               M["fixed_needs_position"]),
            (fixed & (d["platform_name"].isNotNull() | d["instrument_config"].isNotNull()), "platform", loc,
               M["mobile_only_fields"]),
            (mobile & d["platform_name"].isNull(), "platform", loc, M["mobile_needs_platform"]),
            (mobile & (d["lat"].isNotNull() | d["lon"].isNotNull() | d["elevation"].isNotNull()), "platform",
               loc, M["fixed_only_fields"]),
        ])

    return F.when(ok, F.flatten(F.transform(read, per_dep))).otherwise(F.array().cast(_FINDINGS_TYPE))


def all_rules(catalog: DataFrame) -> DataFrame:
    """Every finding of every config of a parsed catalog (dataset_id, rule, location, message)."""
    found = catalog.select("dataset_id", F.explode(findings_column(catalog.sparkSession)).alias("f"))
    return found.select("dataset_id", "f.rule", "f.location", "f.message").unionByName(schema_findings(catalog))


def _only(catalog: DataFrame, names: tuple[str, ...]) -> DataFrame:
    found = catalog.select("dataset_id", F.explode(findings_column(catalog.sparkSession, names)).alias("f"))
    return found.select("dataset_id", "f.rule", "f.location", "f.message")


def rule_schema(catalog: DataFrame) -> DataFrame:
    """V9: JSON object; required, unknown and wrongly typed fields at every depth, dates included."""
    return schema_findings(catalog)


def rule_variable_shape(catalog: DataFrame) -> DataFrame:
    """V1 + V2: exactly one of raw_name / extra_dimension; dims need members, a
    standard name and at least one dimension; member arity equals the dims."""
    return _only(catalog, ("variable_shape", "member_arity"))


def rule_name_collision(catalog: DataFrame) -> DataFrame:
    """V3: a raw column mapped more than once (raw_name, old_names, members)."""
    return _only(catalog, ("name_collision",))


def rule_deployments(catalog: DataFrame) -> DataFrame:
    """V4 + V5: at least one deployment; end after start; only the last open-ended."""
    return _only(catalog, ("deployments",))


def rule_overlap(catalog: DataFrame) -> DataFrame:
    """V6: sorted by start and not overlapping (next element of the same array)."""
    return _only(catalog, ("overlap",))


def rule_platform(catalog: DataFrame) -> DataFrame:
    """V7 + V8: fixed / mobile field requirements; mobile maps latitude and longitude."""
    return _only(catalog, ("platform",))


def validate_verdicts(catalog: DataFrame, violations: DataFrame | None = None,
                      only_source: str | None = None) -> DataFrame:
    """Per config: ``valid`` / ``invalid`` / ``skipped`` (another source type),
    with the number of findings.

    Findings are counted from the exploded findings table and joined back by
    ``dataset_id`` (a filter on the findings array itself would be pushed
    below the parse and re-evaluate it per reference)."""
    found = all_rules(catalog) if violations is None else violations
    n_bad = found.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_violations")).hint("merge")
    skipped = F.lit(False) if only_source is None else (
        F.col("parsed_ok") & F.col("source_type").isin(SOURCE_TYPES) & (F.col("source_type") != only_source))
    out = catalog.select("dataset_id", "parsed_ok", "source_type").join(n_bad, "dataset_id", "left")
    status = F.when(skipped, "skipped").when(F.col("n_violations").isNotNull(), "invalid").otherwise("valid")
    return out.select("dataset_id", status.alias("status"),
                      F.coalesce("n_violations", F.lit(0)).alias("n_violations"))


def validate_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n_configs"))


def _tasks(n: int) -> int:
    """Tasks for ``n`` documents, of at most ``DOCS_PER_TASK``: they compress well, so a reader would give a great many to one task.

    No fewer where the session has few cores, or the longest task would grow with the documents.
    """
    return max(1, -(-n // DOCS_PER_TASK))


def parsed_catalog(docs: DataFrame, root: str) -> tuple[DataFrame, str]:
    """The parsed catalog, stored below ``root`` and made once per state of the documents, and the state's folder.

    A fingerprint of all documents names the state, so listings, rules and
    builds of unchanged documents only read.
    """
    spark = docs.sparkSession
    print_ = docs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("dataset_id", "content")).alias("x"),
                      F.bit_xor(F.xxhash64(F.lit(1), "dataset_id", "content")).alias("y")).first()
    place = f"{root.rstrip('/')}/{print_['n']}-{(print_['x'] or 0) & (2**64 - 1):016x}{(print_['y'] or 0) & (2**64 - 1):016x}"
    parsed = parse_documents(docs.repartition(_tasks(print_["n"])))
    return _stored(StateTable(spark, place + "/catalog", parsed.schema), lambda: parsed), place


def _stored(table: StateTable, make: Callable[[], DataFrame]) -> DataFrame:
    if table.version() == 0:
        try:
            table.replace(make(), 0)
        except ConcurrentUpdate:
            pass  # another job stored the same rows
    return table.read()


def checked_catalog(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The parsed catalog and its findings, both stored below ``root`` and made once per state of the documents."""
    catalog, place = parsed_catalog(docs, root)
    findings = StateTable(docs.sparkSession, place + "/findings", "dataset_id string, rule string, location string, message string")
    return catalog, _stored(findings, lambda: all_rules(catalog.repartition(_tasks(catalog.count()))))


def valid_configs(catalog: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Parsed configs without any finding (what listings and builds may use).

    The files of the findings are small for their rows, so the joins merge: a broadcast would grow with the documents.
    """
    bad = (all_rules(catalog) if findings is None else findings).select("dataset_id").hint("merge")
    return catalog.filter("parsed_ok").join(bad, "dataset_id", "left_anti")


def rule_file_headers(matched: DataFrame, headers: DataFrame) -> DataFrame:
    """V11: files matched by a config's patterns (dataset_id, file_name) that carry no valid header, with the reason."""
    bad = headers.filter(~F.col("valid")).select("file_name", "reason")
    return matched.join(bad, on="file_name").select(
        "dataset_id", F.lit("file_header").alias("rule"), F.col("file_name").alias("location"), F.col("reason").alias("message"))
