"""Column profiling over every header of the fleet, on distinct column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.schemas import KNOWN_VARIABLES, LEVEL_PATTERN, POSITION_NAMES
from fleetseries.session import literal_frame


def known_variables(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, KNOWN_VARIABLES, "known_name string, standard_name string, units string")


def suggest_names(columns: DataFrame) -> DataFrame:
    """(column_name) -> the known variable of that very name: matched_name, standard_name, units (null if none).

    The known table is fixed-size and broadcast.
    """
    names = columns.select("column_name").distinct()
    known = F.broadcast(known_variables(columns.sparkSession))
    return names.join(known, names.column_name == known.known_name, "left").select(
        "column_name", F.col("known_name").alias("matched_name"), "standard_name", "units")


def detect_position(columns: DataFrame) -> DataFrame:
    """Columns named like a latitude / longitude (case-insensitive, exact)."""
    low = F.lower(F.col("column_name"))
    role = F.when(low.isin(POSITION_NAMES["latitude"]), "latitude").when(
        low.isin(POSITION_NAMES["longitude"]), "longitude")
    return columns.withColumn("position", role).filter(F.col("position").isNotNull())


def level_groups(columns: DataFrame, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Columns ``prefix_<level><unit>_suffix`` grouped by (prefix, unit, suffix),
    at least two members, members ordered by level."""
    c = F.col("column_name")
    parsed = columns.select(
        *keys, "column_name",
        F.regexp_extract(c, LEVEL_PATTERN, 1).alias("prefix"),
        F.regexp_extract(c, LEVEL_PATTERN, 2).alias("level_text"),
        F.regexp_extract(c, LEVEL_PATTERN, 3).alias("unit"),
        F.regexp_extract(c, LEVEL_PATTERN, 4).alias("suffix"),
    ).filter(c.rlike(LEVEL_PATTERN))
    parsed = parsed.withColumn("level", F.col("level_text").cast("decimal(38,0)"))
    grouped = parsed.groupBy(*keys, "prefix", "unit", "suffix").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.array_sort(F.collect_list(F.struct("level", "column_name"))).alias("m"),
    ).filter(F.col("n_members") >= 2)
    return grouped.select(
        *keys, "prefix", F.col("unit").alias("dimension_units"), "suffix", "n_members",
        F.array_join(F.transform("m", lambda s: s["column_name"]), ",").alias("members"),
        F.array_join(F.transform("m", lambda s: s["level"].cast("string")), ",").alias("levels"),
    )


def rename_classes(columns: DataFrame, config_names: DataFrame) -> DataFrame:
    """Classify scanned columns against a dataset's configured names: ``already_mapped``
    (raw or old name verbatim), else ``new``.

    ``config_names``: (dataset_id, raw_name) for raw_name and old_names.
    """
    known = config_names.select("dataset_id", F.col("raw_name").alias("column_name")).distinct().withColumn("known", F.lit(True))
    j = columns.select("dataset_id", "column_name").distinct().join(known, ["dataset_id", "column_name"], "left")
    return j.select("dataset_id", "column_name", F.when(F.col("known"), "already_mapped").otherwise("new").alias("classification"))
