"""Incremental file index: which files to (re)parse, state transitions, merge.

The listing carries a change token per entry in ``size`` (``with_change_token``):
bytes for logger files, modification time for flat CSV, newest reading for devices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.schemas import FILE_INDEX


def with_change_token(listing: DataFrame) -> DataFrame:
    """``size`` becomes the change token of each entry's source type: bytes of a logger file,
    modification time (microseconds) of a flat CSV file, newest reading (epoch milliseconds) of a
    device, 0 for a device without readings.

    ``listing`` has source_type, size, modified (timestamp) and last_ts_ms.
    """
    source = F.col("source_type")
    token = (F.when(source == "generic_csv", F.unix_micros(F.col("modified").cast("timestamp")))
             .when(source == "thingsboard", F.coalesce("last_ts_ms", F.lit(0)))
             .otherwise(F.col("size")))
    return listing.withColumn("size", token.cast("bigint"))


def device_bounds(latest: DataFrame, previous: DataFrame) -> DataFrame:
    """Index bounds of telemetry devices from their newest readings (device, key, last_ts_ms, created_ms).

    The first known start stays (the device's creation at first); the end is the newest reading.
    """
    def instant(ms):
        return F.timestamp_millis(ms).cast("timestamp_ntz")

    now = latest.groupBy(F.col("device").alias("dataset_id")).agg(
        instant(F.max("last_ts_ms")).alias("time_end"), instant(F.min("created_ms")).alias("created"),
        F.sort_array(F.collect_set("key")).alias("variables"))
    known = previous.select("dataset_id", F.col("time_start").alias("known_start"))
    return now.join(known, "dataset_id", "left").select(
        "dataset_id", F.col("dataset_id").alias("file_name"), F.coalesce("known_start", "created").alias("time_start"),
        "time_end", "variables")


def refresh_actions(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """Decide per listed file: ``parse`` / ``reuse`` / ``close``.

    archived: closed once parsed, never again; live: parse when new or the
    token changed, else an active entry becomes closed. Files that vanished
    from the listing are not returned (they stay in the stored index).
    """
    prev = previous.select(
        "dataset_id", "file_name",
        F.col("size").alias("prev_size"), F.col("status").alias("prev_status"),
        F.col("time_start").alias("prev_time_start"), F.col("time_end").alias("prev_time_end"),
        F.col("variables").alias("prev_variables"),
    )
    j = listing.join(prev, on=["dataset_id", "file_name"], how="left")
    archived = F.col("file_role") == "archived"
    action = (
        F.when(archived & (F.col("prev_status") == "closed"), "reuse")
        .when(archived, "parse")
        .when(F.col("prev_size").isNull() | (F.col("prev_size") != F.col("size")), "parse")
        .when(F.col("prev_status") == "active", "close")
        .otherwise("reuse")
    )
    status = (
        F.when(archived, "closed")
        .when(F.col("action") == "parse", "active")
        .otherwise("closed")
    )
    return j.withColumn("action", action).withColumn("status", status)


def refreshed_index(actions: DataFrame, parsed_bounds: DataFrame) -> DataFrame:
    """New index rows: parsed files take fresh bounds, the others keep theirs."""
    pb = parsed_bounds.select("dataset_id", "file_name",
                              F.col("time_start").alias("new_start"), F.col("time_end").alias("new_end"),
                              F.col("variables").alias("new_variables"))
    j = actions.join(pb, on=["dataset_id", "file_name"], how="left")
    parsed = F.col("action") == "parse"
    return j.select(
        "dataset_id", "file_name", "file_role", F.col("size").cast("bigint").alias("size"),
        F.when(parsed, F.col("new_start")).otherwise(F.col("prev_time_start")).alias("time_start"),
        F.when(parsed, F.col("new_end")).otherwise(F.col("prev_time_end")).alias("time_end"),
        F.when(parsed, F.col("new_variables")).otherwise(F.col("prev_variables")).alias("variables"),
        "status",
    )


def refresh_summary(actions: DataFrame) -> DataFrame:
    """Per dataset: files matched, newly parsed, reused from the previous index."""
    return actions.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.count_if(F.col("action") == "parse").cast("bigint").alias("n_parsed"),
        F.count_if(F.col("action") != "parse").cast("bigint").alias("n_reused"),
    )


def merge_index(previous: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by (dataset_id, file_name): update rows replace stored rows, other
    stored rows stay. Written as union + newest-wins per key; of several rows of one
    key the one with the greatest token."""
    cols = [f.name for f in FILE_INDEX.fields]
    both = previous.select(*cols, F.lit(0).alias("_gen")).unionByName(
        updates.select(*cols, F.lit(1).alias("_gen")))
    w = Window.partitionBy("dataset_id", "file_name").orderBy(F.col("_gen").desc(), F.col("size").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_gen")
