"""Coverage, global and provenance attributes (one row per dataset)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.scalar import iso, iso_z, ts_lit
from fleetseries.operators.mapping import BAD_VALUES, render_warnings, resolve_canonical
from fleetseries.schemas import HISTORY_HASH_CHARS, MESSAGES, SOFTWARE_NAME, SOFTWARE_VERSION


def time_coverage(index: DataFrame) -> DataFrame:
    """Overall observed range over files that have data; datasets without any
    bounded file get no row."""
    return (
        index.filter(F.col("time_start").isNotNull() & F.col("time_end").isNotNull())
        .groupBy("dataset_id")
        .agg(F.min("time_start").alias("data_start"), F.max("time_end").alias("data_end"))
    )


def coverage_attrs(built: DataFrame) -> DataFrame:
    """Time range as ISO text with ``Z``; latitude / longitude bounds ignoring
    missing values (null = attribute omitted). Map-side partial aggregation."""
    has_lat = "latitude" in built.columns
    aggs = [F.min("time").alias("_t0"), F.max("time").alias("_t1")]
    if has_lat:
        aggs += [
            F.min("latitude").alias("geospatial_lat_min"),
            F.max("latitude").alias("geospatial_lat_max"),
            F.min("longitude").alias("geospatial_lon_min"),
            F.max("longitude").alias("geospatial_lon_max"),
        ]
    out = built.groupBy("dataset_id").agg(*aggs)
    out = out.withColumn("time_coverage_start", iso_z("_t0")).withColumn(
        "time_coverage_end", iso_z("_t1")).drop("_t0", "_t1")
    return out


def global_attrs(catalog: DataFrame) -> DataFrame:
    """Metadata entries with a value, plus dataset id, platform and source type."""
    meta = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                        lambda k, v: v.isNotNull())
    extra = F.create_map(
        F.lit("dataset_id"), F.col("dataset_id"),
        F.lit("platform_type"), F.col("platform_type"),
        F.lit("source_type"), F.col("source_type"),
    )
    return catalog.select("dataset_id", F.map_concat(meta, extra).alias("attrs"))


def provenance(current_versions: DataFrame, generated_at: datetime | str) -> DataFrame:
    """Software version, config hash and version time, and a history line."""
    gen = iso(ts_lit(generated_at))
    return current_versions.select(
        "dataset_id",
        F.lit(SOFTWARE_VERSION).alias("processing_software_version"),
        F.col("hash").alias("config_hash"),
        iso("created_at").alias("config_version_timestamp"),
        F.format_string(
            MESSAGES["history"],
            gen, F.lit(SOFTWARE_NAME), F.lit(SOFTWARE_VERSION), F.col("dataset_id"),
            F.substring("hash", 1, HISTORY_HASH_CHARS),
        ).alias("history"),
    )


def side_totals(built: DataFrame) -> DataFrame:
    """One pass over a written build: per (dataset_id, variable, value) the count of bad values, and under a null
    variable the number of rows with the bounds of time and position. Partial aggregates per task."""
    bad = F.coalesce("bad_values", F.array().cast(BAD_VALUES)) if "bad_values" in built.columns else F.array().cast(BAD_VALUES)
    row = F.array(F.struct(F.lit(None).cast("string").alias("variable"), F.lit(None).cast("string").alias("value")))
    place = [F.col(c).cast("double").alias(c) if c in built.columns else F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")]
    tagged = built.select("dataset_id", "time", *place, F.inline(F.concat(row, bad)))
    return tagged.groupBy("dataset_id", "variable", "value").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("time", "latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))])


def bad_counts(totals: DataFrame, columns: Sequence[dict]) -> DataFrame:
    """(dataset_id, canonical_name, raw_value, n, var_ord) of the bad values in ``totals``, in column order."""
    names = F.array(*[F.lit(c["canonical_name"]) for c in columns])
    return totals.filter("variable is not null").select(
        "dataset_id", F.col("variable").alias("canonical_name"), F.col("value").alias("raw_value"), "n",
        F.array_position(names, F.col("variable")).cast("int").alias("var_ord"))


def build_attrs(totals: DataFrame, columns: Sequence[dict], attrs: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(dataset_id, attrs) of a built dataset: given attributes, coverage of what was built, quality warnings, provenance.

    ``totals`` is ``side_totals`` of the build, ``attrs`` (dataset_id, attrs map) e.g.
    ``global_attrs``, ``versions`` the result of ``provenance``. Attributes without a
    value are left out; a dataset without rows keeps its given ones.
    """
    warnings = render_warnings(bad_counts(totals, columns)).groupBy("dataset_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("var_ord", "warning"))), lambda w: w["warning"]), "; ")
        .alias("data_quality_warnings"))
    cover = totals.filter("variable is null").select(
        "dataset_id", iso_z("time_min").alias("time_coverage_start"), iso_z("time_max").alias("time_coverage_end"),
        *[F.col(f"{c}_{n}").cast("string").alias(f"geospatial_{s}_{n}") for c, s in (("latitude", "lat"), ("longitude", "lon")) for n in ("min", "max")])
    parts = [cover, warnings] + ([versions] if versions is not None else [])
    out, found = attrs, []
    for part in parts:
        out = out.join(part, "dataset_id", "left")
        found += [c for c in part.columns if c != "dataset_id"]
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in found]), lambda e: e["value"].isNotNull())
    given = F.map_filter("attrs", lambda k, v: ~k.isin(found))
    return out.select("dataset_id", F.map_concat(given, F.map_from_entries(entries)).alias("attrs"))


def variable_attrs(vmap: DataFrame, headers: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row per dataset and mapped variable: standard_name, units, dtype from the config; the logger's own units and
    aggregation types from the headers (dataset_id, columns, units, agg_types), distinct ones sorted; n_bad values.

    Variables of which no file has a column are absent.
    """
    zipped = F.arrays_zip(F.col("columns").alias("raw_name"), F.col("units").alias("unit"), F.col("agg_types").alias("agg"))
    own = headers.select("dataset_id", F.inline(zipped)).distinct()
    keys = ["dataset_id", "raw_name"] if "dataset_id" in vmap.columns else ["raw_name"]
    met = own.join(resolve_canonical(vmap).select(*keys, "canonical_name", "standard_name", F.col("units").alias("config_units"), "dtype"), keys)

    def texts(c: str):
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",")

    out = met.groupBy("dataset_id", "canonical_name").agg(
        F.first("standard_name", ignorenulls=True).alias("standard_name"), F.first("config_units", ignorenulls=True).alias("units"),
        F.first("dtype").alias("dtype"), texts("unit").alias("logger_units"), texts("agg").alias("agg_types"))
    if totals is None:
        return out.withColumn("n_bad", F.lit(0).cast("bigint"))
    bad = totals.filter("variable is not null").groupBy("dataset_id", F.col("variable").alias("canonical_name")).agg(F.sum("n").alias("n_bad"))
    return out.join(bad, ["dataset_id", "canonical_name"], "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))


def attrs_text(attrs: DataFrame, col: str = "attrs") -> DataFrame:
    """A map column rendered as sorted ``k=v`` pairs joined by ``;``."""
    return attrs.withColumn(
        f"{col}_text",
        F.array_join(
            F.transform(F.array_sort(F.map_entries(col)),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"])),
            ";",
        ),
    )
