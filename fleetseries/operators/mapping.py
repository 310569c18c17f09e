"""Variable mapping: raw columns -> canonical variables.

Long path (fleet-wide, any number of config signatures): explode the deduped
``cells`` maps, join the ``variable_map`` (broadcast when its estimated size is
small), coalesce aliases, coerce types, report bad values.

Wide path (one config signature): plain column expressions over ``cells``;
no shuffle beyond the de-duplication.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.functions.scalar import bad_number, parse_number, wide_column_name
from fleetseries.schemas import DIM, MESSAGES, VARIABLE_MAP
from fleetseries.session import broadcast_if_small, literal_frame

# ---------------------------------------------------------------------------
# variable_map construction


def _dims_of(spec: dict) -> list[dict]:
    dims = spec.get("extra_dimension")
    if dims is None:
        return []
    return dims if isinstance(dims, list) else [dims]


def _dim_struct(dim: dict, value) -> tuple:
    if isinstance(value, bool):
        value = str(value)
    if isinstance(value, (int, float)):
        return (dim["name"], dim.get("units"), float(value), None)
    return (dim["name"], dim.get("units"), None, str(value))


def canonical_name_of(spec: dict) -> str:
    return spec.get("standard_name") or spec.get("raw_name")


def variable_map_rows(specs: Sequence[dict], dataset_id: str | None = None) -> list[tuple]:
    """Rows of ``variable_map`` for one config's ``variables`` list."""
    rows = []
    for var_ord, spec in enumerate(specs):
        dims = _dims_of(spec)
        base = (
            dataset_id,
            var_ord,
            canonical_name_of(spec),
            spec.get("standard_name"),
            spec.get("units"),
            spec.get("dtype", "numeric"),
        )
        if dims:
            for member_ord, member in enumerate(spec.get("members", [])):
                value = member["dimension_value"]
                values = value if isinstance(value, list) else [value]
                dim_structs = [_dim_struct(d, v) for d, v in zip(dims, values)]
                rows.append(base + (member["raw_name"], 0, member_ord, dim_structs))
        else:
            names = [spec["raw_name"], *spec.get("old_names", [])]
            for alias_ord, name in enumerate(names):
                rows.append(base + (name, alias_ord, None, []))
    return rows


def variable_map_from_specs(spark: SparkSession, specs: Sequence[dict],
                            dataset_id: str | None = None) -> DataFrame:
    """A config-sized ``variable_map`` (bounded by the config, safe to broadcast).

    With ``dataset_id=None`` the map is a shared template: it joins on
    ``raw_name`` alone and applies to every dataset of the signature.
    """
    df = literal_frame(spark, variable_map_rows(specs, dataset_id), VARIABLE_MAP)
    if dataset_id is None:
        df = df.drop("dataset_id")
    return df


def variable_map_from_catalog(catalog: DataFrame) -> DataFrame:
    """``variable_map`` for every dataset of a parsed catalog (``variables`` array
    of the config schema). Extra dimensions arrive as JSON text (a bare object or an
    array); member values are taken from the document itself, with their JSON types."""
    dim_t = T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                      T.StructField("units", T.StringType())]))
    value_t = "struct<num:double,txt:string>"

    def scalar(x: Column) -> Column:
        """A number stays a number, a text stays a text, whatever it looks like."""
        number = F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.struct(F.when(number, F.try_variant_get(x, "$", "double")).alias("num"),
                        F.when(~number, F.try_variant_get(x, "$", "string")).alias("txt")).cast(value_t)

    def member_values(v: Column) -> Column:
        members = F.coalesce(F.try_variant_get(v, "$.members", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(members, lambda m: F.coalesce(
            F.transform(F.try_variant_get(m, "$.dimension_value", "array<variant>"), scalar),
            F.array(scalar(F.try_variant_get(m, "$.dimension_value", "variant")))))

    written = F.coalesce(F.try_variant_get(F.try_parse_json("content"), "$.variables", "array<variant>"), F.array().cast("array<variant>"))
    both = F.arrays_zip(F.col("variables").alias("v"), F.transform(written, member_values).alias("values"))
    v = catalog.select("dataset_id", F.posexplode(both).alias("var_ord", "b")).select("dataset_id", "var_ord", "b.v", "b.values")
    dims_json = F.col("v.extra_dimension")
    dims = F.when(dims_json.isNull(), F.lit(None).cast(dim_t)).when(
        F.startswith(F.ltrim(dims_json), F.lit("[")), F.from_json(dims_json, dim_t)
    ).otherwise(F.array(F.from_json(dims_json, dim_t.elementType)))
    members_t = f"array<struct<m:struct<raw_name:string,dimension_value:string>,values:array<{value_t}>>>"
    v = v.select(
        "dataset_id", "var_ord",
        F.coalesce(F.col("v.standard_name"), F.col("v.raw_name")).alias("canonical_name"),
        F.col("v.standard_name").alias("standard_name"),
        F.col("v.units").alias("units"),
        F.coalesce(F.col("v.dtype"), F.lit("numeric")).alias("dtype"),
        F.col("v.raw_name").alias("raw_name"),
        F.coalesce(F.col("v.old_names"), F.array().cast("array<string>")).alias("old_names"),
        dims.alias("dim_decl"),
        F.coalesce(F.arrays_zip(F.col("v.members").alias("m"), F.col("values").alias("values")).cast(members_t),
                   F.array().cast(members_t)).alias("members"),
    )
    plain = v.filter(F.col("dim_decl").isNull()).select(
        "dataset_id", "var_ord", "canonical_name", "standard_name", "units", "dtype",
        F.posexplode(F.concat(F.array("raw_name"), F.col("old_names"))).alias("alias_ord", "raw_name"),
    ).select(
        "dataset_id", "var_ord", "canonical_name", "standard_name", "units", "dtype",
        "raw_name", "alias_ord",
        F.lit(None).cast("int").alias("member_ord"),
        F.array().cast(T.ArrayType(DIM)).alias("dims"),
    )
    members = v.filter(F.col("dim_decl").isNotNull()).select(
        "dataset_id", "var_ord", "canonical_name", "standard_name", "units", "dtype", "dim_decl",
        F.posexplode("members").alias("member_ord", "member"),
    )
    members = members.select(
        "dataset_id", "var_ord", "canonical_name", "standard_name", "units", "dtype",
        F.col("member.m.raw_name").alias("raw_name"),
        F.lit(0).alias("alias_ord"),
        F.col("member_ord").cast("int").alias("member_ord"),
        F.zip_with("dim_decl", "member.values", lambda d, x: F.struct(
            d["name"].alias("name"), d["units"].alias("units"), x["num"].alias("num"), x["txt"].alias("txt"))).alias("dims"),
    )
    out = plain.unionByName(members)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in VARIABLE_MAP.fields])


def resolve_canonical(vmap: DataFrame) -> DataFrame:
    """Duplicate canonical names: the last declared variable wins."""
    keys = ["dataset_id"] if "dataset_id" in vmap.columns else []
    w = Window.partitionBy(*keys, "canonical_name")
    return (
        vmap.withColumn("_last", F.max("var_ord").over(w))
        .filter(F.col("var_ord") == F.col("_last"))
        .drop("_last")
    )


def restrict_to_variables(vmap: DataFrame, variables: Iterable[str] | None) -> DataFrame:
    """Raw-column resolution for requested canonical names (unknown names ignored)."""
    if variables is None:
        return vmap
    return vmap.filter(F.col("canonical_name").isin(list(variables)))


# ---------------------------------------------------------------------------
# long path


def prune_cells(rows: DataFrame, raw_names: Sequence[str]) -> DataFrame:
    """Cut ``cells`` to the needed raw columns before any shuffle."""
    names = F.array(*[F.lit(n) for n in raw_names])
    return rows.withColumn("cells", F.map_filter("cells", lambda k, v: F.array_contains(names, k)))


def explode_cells(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return rows.select(
        "dataset_id", "time", *keep,
        F.explode("cells").alias("raw_name", "raw_value"),
    )


def map_long(raw_long: DataFrame, vmap: DataFrame) -> DataFrame:
    """Raw long cells -> canonical observations.

    Inner join with the map drops unmapped raw columns (never reach output);
    aliases are coalesced on raw text first (first non-missing by alias order),
    then coerced (so a bad raw value beats a good old-name value).
    """
    vmap = resolve_canonical(vmap)
    keys = ["dataset_id", "raw_name"] if "dataset_id" in vmap.columns else ["raw_name"]
    joined = raw_long.filter(F.col("raw_value").isNotNull()).join(
        broadcast_if_small(vmap), on=keys, how="inner"
    )
    group = ["dataset_id", "time", "canonical_name", "member_ord"]
    picked = joined.groupBy(*group).agg(
        F.min_by(
            F.struct("raw_value", "raw_name", "var_ord", "standard_name", "units", "dtype", "dims"),
            F.col("alias_ord"),
        ).alias("p")
    )
    return coerce(picked.select(*group, "p.*"))


def coerce(obs: DataFrame) -> DataFrame:
    """Numeric variables: regex-guarded parse, NaN -> null; string variables untouched."""
    numeric = F.col("dtype") == "numeric"
    num = F.when(numeric, parse_number("raw_value"))
    num = F.when(F.isnan(num), F.lit(None).cast("double")).otherwise(num)
    return obs.withColumn("value_num", num).withColumn(
        "value_str", F.when(~numeric, F.col("raw_value"))
    ).withColumn("bad", numeric & bad_number("raw_value", "value_num"))


def quality_examples(obs: DataFrame) -> DataFrame:
    """Long form of the quality report: one row per (dataset, variable, distinct
    bad value) with its count. Fully distributed; the one-line warning below is
    a per-variable rendering of it."""
    return obs.filter(F.col("bad")).groupBy("dataset_id", "canonical_name", "raw_value").agg(
        F.count(F.lit(1)).alias("n"), F.min("var_ord").alias("var_ord"))


def quality_report(obs: DataFrame) -> DataFrame:
    """Per (dataset, variable): count of unparseable values and their sorted
    distinct examples, rendered as one warning line.

    Pre-aggregated per distinct bad value first, so a hot variable never puts
    its raw rows into one task: only the distinct bad values are collected.
    """
    return render_warnings(quality_examples(obs))


def render_warnings(per_value: DataFrame) -> DataFrame:
    """The report from counts per distinct bad value (dataset_id, canonical_name, raw_value, n, var_ord)."""
    per_var = per_value.groupBy("dataset_id", "canonical_name").agg(
        F.sum("n").alias("n_bad"),
        F.min("var_ord").alias("var_ord"),
        F.sort_array(F.collect_list("raw_value")).alias("examples"),
    )
    rendered = F.concat(
        F.lit("["),
        F.array_join(F.transform("examples", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
        F.lit("]"),
    )
    return per_var.withColumn(
        "warning",
        F.format_string(
            MESSAGES["quality_warning"],
            F.col("canonical_name"), F.col("n_bad"), rendered,
        ),
    )


def dimension_combinations(vmap: DataFrame) -> DataFrame:
    """Per stacked variable: every combination of its dimensions' declared
    values (first-declared order per dimension), as one array per variable.
    Config-sized: the product of a few declared values."""
    keys = ["dataset_id"] if "dataset_id" in vmap.columns else []
    stacked = resolve_canonical(vmap).filter(F.size("dims") > 0)
    per_dim = stacked.select(*keys, "canonical_name", "member_ord",
                             F.posexplode("dims").alias("dim_pos", "d"))
    values = per_dim.groupBy(*keys, "canonical_name", "dim_pos").agg(
        F.array_sort(F.collect_set(F.struct(F.col("member_ord").alias("first_ord"), F.col("d")))).alias("vals"))
    values = values.select(*keys, "canonical_name", "dim_pos",
                           F.array_distinct(F.transform("vals", lambda x: x["d"])).alias("vals"))
    per_var = values.groupBy(*keys, "canonical_name").agg(
        F.array_sort(F.collect_list(F.struct("dim_pos", "vals"))).alias("axes"))
    # cartesian product of the axes, folded left to right (arrays of a few values)
    start = F.array(F.struct(F.array().cast(T.ArrayType(DIM)).alias("dims"),
                             F.array().cast("array<int>").alias("dim_ord")))
    product = F.aggregate(
        "axes", start,
        lambda acc, axis: F.flatten(F.transform(acc, lambda a: F.transform(
            axis["vals"], lambda v, j: F.struct(F.concat(a["dims"], F.array(v)).alias("dims"),
                                                F.concat(a["dim_ord"], F.array(j)).alias("dim_ord"))))),
    )
    return per_var.select(*keys, "canonical_name", product.alias("combos"))


def complete_dimensions(obs: DataFrame, vmap: DataFrame) -> DataFrame:
    """Every declared combination of a stacked variable's dimension values exists
    for each (dataset, time) where the variable is present; missing -> null.

    One grouped pass per (dataset, time, variable) — a superset of the dedup
    partitioning, so no shuffle follows the dedup — collecting the present
    members (bounded by the member count of the config) and expanding them over
    the broadcast combination list.
    """
    keys = ["dataset_id"] if "dataset_id" in vmap.columns else []
    combos = dimension_combinations(vmap)
    present = obs.filter(F.size("dims") > 0).groupBy("dataset_id", "time", "canonical_name").agg(
        F.collect_list(F.struct("dims", "value_num", "value_str")).alias("vals"))
    j = present.join(broadcast_if_small(combos), on=[*keys, "canonical_name"], how="inner")
    cell = F.explode(F.transform("combos", lambda c: F.struct(
        c["dims"].alias("dims"), c["dim_ord"].alias("dim_ord"),
        F.get(F.filter("vals", lambda v: v["dims"] == c["dims"]), 0).alias("v"))))
    out = j.select("dataset_id", "time", "canonical_name", cell.alias("c"))
    return out.select("dataset_id", "time", "canonical_name", F.col("c.dims").alias("dims"),
                      F.col("c.dim_ord").alias("dim_ord"), F.col("c.v.value_num").alias("value_num"),
                      F.col("c.v.value_str").alias("value_str"))


# ---------------------------------------------------------------------------
# wide path


def wide_columns(specs: Sequence[dict], variables: Iterable[str] | None = None) -> list[dict]:
    """Output columns of one config signature, in declaration order, read off its variable map.

    A plain variable gives one column with its raw names by alias order. A
    stacked one gives a column per combination of its dimensions' declared
    values; combinations without a member have no raw name. Of several
    declarations of a canonical name, and of a column name, the last counts.
    """
    wanted = None if variables is None else set(variables)
    declared: dict[int, list[tuple]] = {}
    last: dict[str, int] = {}
    for row in variable_map_rows(specs):
        declared.setdefault(row[1], []).append(row)
        last[row[2]] = row[1]
    out: dict[str, dict] = {}

    def put(column: str, row: tuple, raw_names: list[str], dims: list[tuple]) -> None:
        out[column] = {"column": column, "canonical_name": row[2], "dtype": row[5], "raw_names": raw_names, "dims": dims}

    for var_ord, rows in declared.items():
        name = rows[0][2]
        if last[name] != var_ord or (wanted is not None and name not in wanted):
            continue
        if not rows[0][9]:
            put(name, rows[0], [r[6] for r in sorted(rows, key=lambda r: r[7])], [])
            continue
        raw_of = {tuple(r[9]): r[6] for r in rows}
        cells = [((), name)]
        for axis in zip(*(r[9] for r in rows)):  # the values declared along one dimension, repeats dropped
            cells = [(dims + (d,), f"{column}_{_axis_label(d)}") for dims, column in cells for d in dict.fromkeys(axis)]
        for dims, column in cells:
            put(column, rows[0], [raw_of[dims]] if dims in raw_of else [], list(dims))
    return list(out.values())


def _axis_label(dim: tuple) -> str:
    """A (name, units, num, txt) dimension value as ``wide_column_name`` renders it."""
    _, units, num, txt = dim
    if num is None:
        return "_".join(txt.strip(" ").split(" "))
    return repr(num).removesuffix(".0") + (units or "")


def stack_cells(rows: DataFrame, specs: Sequence[dict], keep: Sequence[str] = ("dataset_id", "time")) -> DataFrame:
    """Stacked variables of one config signature from de-duplicated rows with ``cells``, as long rows
    (kept keys, canonical_name, dims, dim_ord, value_num, value_str).

    Members are picked from the row's cells and every declared combination is
    listed in place, so nothing is shuffled; a row without any member of a
    variable gives none of its combinations.
    """
    stacked: dict[str, list[dict]] = {}
    for c in wide_columns(specs):
        if c["dims"]:
            stacked.setdefault(c["canonical_name"], []).append(c)
    groups = []
    for name, columns in stacked.items():
        places = [{d: i for i, d in enumerate(dict.fromkeys(axis))} for axis in zip(*(c["dims"] for c in columns))]
        entries = []
        for c in columns:
            raw = F.col("cells").getItem(c["raw_names"][0]) if c["raw_names"] else F.lit(None).cast("string")
            num = parse_number(raw)
            numeric = c["dtype"] == "numeric"
            entries.append(F.struct(
                F.lit(name).alias("canonical_name"),
                F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(d, DIM.fields)]) for d in c["dims"]]).alias("dims"),
                F.array(*[F.lit(p[d]) for p, d in zip(places, c["dims"])]).alias("dim_ord"),
                (F.when(F.isnan(num), F.lit(None).cast("double")).otherwise(num) if numeric else F.lit(None).cast("double")).alias("value_num"),
                (F.lit(None).cast("string") if numeric else raw).alias("value_str")))
        members = [n for c in columns for n in c["raw_names"]]
        present = F.coalesce(*[F.col("cells").getItem(n) for n in members]) if len(members) > 1 else F.col("cells").getItem(members[0])
        groups.append(F.when(present.isNotNull(), F.array(*entries)))
    found = F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull()))
    return rows.select(*keep, F.inline(found))


BAD_VALUES = "array<struct<variable:string,value:string>>"


def map_wide(rows: DataFrame, columns: Sequence[dict], keep: Sequence[str] = ("dataset_id", "time"),
             report_bad: bool = False) -> DataFrame:
    """Wide mapping as column expressions on ``cells`` (no shuffle).

    Returns the kept key columns plus one typed column per output column, and
    with ``report_bad`` the column ``bad_values``: the variables and texts of the
    row that are no numbers (so quality can be summed up from what is written).
    Columns whose raw names are absent everywhere stay null here; header-level
    absence is decided by the caller from the file headers.
    """
    exprs: list[Column] = []
    bad: list[Column] = []
    for c in columns:
        raw = [F.col("cells").getItem(n) for n in c["raw_names"]]
        value = F.coalesce(*raw) if len(raw) > 1 else (raw[0] if raw else F.lit(None).cast("string"))
        if c["dtype"] == "numeric":
            num = parse_number(value)
            number = F.when(F.isnan(num), F.lit(None).cast("double")).otherwise(num)
            bad.append(F.when(bad_number(value, number), F.struct(F.lit(c["canonical_name"]).alias("variable"), value.alias("value"))))
            value = number
        exprs.append(value.alias(c["column"]))
    if report_bad:
        found = F.filter(F.array(*bad), lambda b: b.isNotNull()) if bad else F.array()
        exprs.append(found.cast(BAD_VALUES).alias("bad_values"))
    return rows.select(*keep, *exprs)


def wide_name_column(df: DataFrame, name: str = "canonical_name", dims: str = "dims") -> DataFrame:
    return df.withColumn("column_name", wide_column_name(F.col(name), F.col(dims)))
