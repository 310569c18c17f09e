"""Typed walk over config documents, from one table of declared fields.

A document becomes a variant value. All its objects (the document, its source,
variables, dimensions, members, deployments, metadata, output) are listed with
their path and kind, and each meets the fields declared for its kind
(``schemas.CONFIG_FIELDS``): missing and unknown fields, and values of another
type, each become a finding. One projection and one join with a literal table;
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseries.schemas import CONFIG_FIELDS, FALSE_TEXTS, NUMBER_PATTERN, OPEN_KINDS, SOURCE_TYPES, TRUE_TEXTS, VALUE_KINDS
from fleetseries.session import let, literal_frame

_OBJECT = "struct<kind:string,path:string,value:variant>"
_FINDING = "array<struct<rule:string,location:string,message:string>>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _items(v: Column, path: str) -> Column:
    """The elements of an array (none if the value is no array)."""
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _object(kind: Column | str, path: Column | str, value: Column) -> Column:
    kind, path = (F.lit(x) if isinstance(x, str) else x for x in (kind, path))
    return F.struct(kind.alias("kind"), path.alias("path"), value.alias("value"))


def _base(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, OBJECT or ARRAY."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def objects(root: Column) -> Column:
    """Every object of a document (and what stands where one should) as (kind, path, value)."""

    def of_variable(v: Column, i: Column) -> Column:
        path = F.format_string("variables[%d]", i)
        bare = let(_get(v, "$.extra_dimension", "variant"), lambda dims: F.when(
            _base(dims) == "OBJECT", F.array(_object("dimension", F.concat(path, F.lit(".extra_dimension")), dims))))
        listed = F.transform(_items(v, "$.extra_dimension"), lambda x, j: _object(
            "dimension", F.concat(path, F.format_string(".extra_dimension[%d]", j)), x))
        members = F.transform(_items(v, "$.members"), lambda x, j: _object(
            "member", F.concat(path, F.format_string(".members[%d]", j)), x))
        return F.concat(F.array(_object("variable", path, v)), F.coalesce(bare, listed), members)

    source = _get(root, "$.source_type", "string")
    single = F.array(
        _object("document", "document", root),
        F.when(source.isin(SOURCE_TYPES), _object(source, "source_config", _get(root, "$.source_config", "variant"))),
        _object("metadata", "metadata", _get(root, "$.metadata", "variant")),
        _object("output", "output", _get(root, "$.output", "variant")),
    )
    deployments = F.transform(_items(root, "$.deployments"), lambda x, i: _object("deployment", F.format_string("deployments[%d]", i), x))
    listed = F.concat(single, F.flatten(F.transform(_items(root, "$.variables"), of_variable)), deployments)
    return F.filter(listed.cast(f"array<{_OBJECT}>"), lambda o: o.isNotNull() & o["value"].isNotNull())


def _fits(kind: Column, base: Column, text: Column, choices: Column, value: Column) -> Column:
    number = base.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT")
    is_text = base == "STRING"
    all_text = F.forall(_items(value, "$"), lambda x: _base(x) == "STRING")
    return (
        F.when(kind == "text", is_text)
        .when(kind == "choice", is_text & F.array_contains(choices, text))
        .when(kind == "number", number | (base == "BOOLEAN") | (is_text & text.rlike(NUMBER_PATTERN)))
        .when(kind == "time", number | (is_text & F.try_to_timestamp(text).isNotNull()))
        .when(kind == "flag", (base == "BOOLEAN") | F.lower(text).isin(TRUE_TEXTS + FALSE_TEXTS))
        .when(kind == "list", base == "ARRAY")
        .when(kind == "names", (base == "ARRAY") & all_text)
        .when(kind == "object", base == "OBJECT")
        .when(kind == "dimensions", base.isin("OBJECT", "ARRAY"))
        .otherwise(number | is_text | base.isin("BOOLEAN", "ARRAY"))
    )


def _finding(location: Column, message: Column) -> Column:
    return F.struct(F.lit("schema").alias("rule"), location.alias("location"), message.alias("message"))


def _object_findings() -> Column:
    """Findings of one (kind, path, value, cells) row joined with what is declared for its kind."""
    cells = F.col("cells")
    keys = F.map_keys(cells)
    missing = F.array_except(F.col("required"), keys)
    unknown = F.when(F.col("open"), F.array().cast("array<string>")).otherwise(F.array_except(keys, F.col("names")))
    path = F.col("path")

    def looked_up(f: Column) -> Column:
        return F.struct(f.alias("f"), F.element_at(cells, f["name"]).alias("value"))

    def read(x: Column) -> Column:
        return F.struct(x["f"].alias("f"), x["value"].alias("value"), _base(x["value"]).alias("base"), _get(x["value"], "$", "string").alias("text"))

    def typed(x: Column) -> Column:
        f, value, base, text = x["f"], x["value"], x["base"], x["text"]
        wrong = ~(f["nullable"] & (base == "VOID")) & ~F.coalesce(_fits(f["type"], base, text, f["choices"], value), F.lit(False))
        shown = F.when(base.isin("OBJECT", "ARRAY"), F.lower(base)).when(base == "VOID", "null").otherwise(text)
        where = F.when(path == "document", f["name"]).otherwise(F.concat(path, F.lit("."), f["name"]))
        return F.when(wrong, _finding(where, F.concat(f["name"], F.lit(" must be "), f["wanted"], F.lit(", got "), shown)))

    # one step at a time, so that a value is looked up and read once however often the last step names it
    given = F.transform(F.filter(F.transform("fields", looked_up), lambda x: x["value"].isNotNull()), read)

    in_keys = F.concat(
        F.when(F.size(missing) > 0, F.array(_finding(path, F.concat(F.lit("missing fields: "), F.array_join(F.array_sort(missing), ","))))).otherwise(
            F.array().cast(_FINDING)),
        F.when(F.size(unknown) > 0, F.array(_finding(path, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(unknown), ","))))).otherwise(
            F.array().cast(_FINDING)),
    )
    of_object = F.concat(in_keys, F.filter(F.transform(given, typed), lambda x: x.isNotNull()))
    # an entry of a list that is no object; a field that should be one is found at its parent
    stray = F.when(path.endswith("]"), F.array(_finding(path, F.lit("must be an object")))).otherwise(F.array().cast(_FINDING))
    return F.when(cells.isNull(), stray).otherwise(of_object)


def schema_findings(catalog: DataFrame) -> DataFrame:
    """(dataset_id, rule 'schema', location, message) of every document of (dataset_id, content, parsed_ok)."""
    spec = [
        (kind, kind in OPEN_KINDS, [name for name, *_ in fields], [name for name, _, required, *_ in fields if required],
         [(name, t, nullable, list(choices), "one of " + "|".join(choices) if t == "choice" else VALUE_KINDS.get(t))
          for name, t, _, nullable, choices in fields])
        for kind, fields in CONFIG_FIELDS.items()
    ]
    declared = literal_frame(
        catalog.sparkSession, spec,
        "kind string, open boolean, names array<string>, required array<string>, "
        "fields array<struct<name:string,type:string,nullable:boolean,choices:array<string>,wanted:string>>")
    # one JSON number is read as an exact decimal where it fits: types are told apart, not rounded
    root = F.try_parse_json("content")
    walked = catalog.filter("parsed_ok").select("dataset_id", root.alias("root"))
    listed = walked.select("dataset_id", F.explode(objects(F.col("root"))).alias("o")).select("dataset_id", "o.*")
    listed = listed.withColumn("cells", _get(F.col("value"), "$", "map<string,variant>"))
    typed = listed.join(F.broadcast(declared), "kind").select("dataset_id", F.explode(_object_findings()).alias("f"))
    unread = F.when(~F.col("parsed_ok"), "invalid JSON").otherwise("repeated keys")
    broken = catalog.filter(~F.col("parsed_ok") | root.isNull()).select(
        "dataset_id", F.lit("schema").alias("rule"), F.lit("document").alias("location"), unread.alias("message"))
    return typed.select("dataset_id", "f.rule", "f.location", "f.message").unionByName(broken)
