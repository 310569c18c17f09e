"""Dataset config documents: one JSON file per dataset (id = file stem), or
JSON-lines with an ``id`` field; several sources are unioned with a source id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_config_dir(spark: SparkSession, path: str, source_id: str = "default") -> DataFrame:
    """(source_id, dataset_id, content) from ``*.json`` files, one document each."""
    df = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return df.select(
        F.lit(source_id).alias("source_id"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("dataset_id"),
        F.col("value").alias("content"),
    )


def read_config_lines(spark: SparkSession, path: str, source_id: str = "default") -> DataFrame:
    """(source_id, dataset_id, content) from JSON-lines documents with an ``id``."""
    df = spark.read.text(path)
    return df.select(
        F.lit(source_id).alias("source_id"),
        F.get_json_object("value", "$.id").alias("dataset_id"),
        F.col("value").alias("content"),
    ).filter(F.length(F.trim("content")) > 0)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
