"""Deployment lookup: the deployment valid at each reading's time.

Windows are half-open ``[start, end)``, ``end`` null means open. Readings
outside every window keep null position / platform.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.functions.scalar import ts_lit
from fleetseries.session import broadcast_if_small

FIXED_COLUMNS = ["lat", "lon", "elevation"]
POSITION_NAMES = {"lat": "latitude", "lon": "longitude", "elevation": "elevation"}


def _in_window(time_col, start_col, end_col):
    return (time_col >= start_col) & (end_col.isNull() | (time_col < end_col))


def attach_deployments(obs: DataFrame, deployments: DataFrame, platform_type: str = "fixed",
                       keep_dep_ord: bool = False) -> DataFrame:
    """Range join on ``dataset_id`` equality plus the window condition.

    The equality keeps it a hash join (broadcast when the deployment table's
    estimated size is small, a shuffle join otherwise) with the range as a
    residual condition; windows of one dataset never overlap, so each reading
    matches at most one deployment (no fan-out).
    """
    if platform_type == "fixed":
        payload = [F.col(c).alias(f"_dep_{c}") for c in FIXED_COLUMNS]
    else:
        payload = [F.col("platform_name").alias("_dep_platform_name")]
    deps = deployments.select(
        F.col("dataset_id").alias("_dep_ds"), F.col("start").alias("_dep_start"),
        F.col("end").alias("_dep_end"), F.col("dep_ord").alias("_dep_ord"), *payload,
    )
    cond = (F.col("dataset_id") == F.col("_dep_ds")) & _in_window(
        F.col("time"), F.col("_dep_start"), F.col("_dep_end"))
    joined = obs.join(broadcast_if_small(deps), on=cond, how="left")
    if platform_type == "fixed":
        out = joined
        for c in FIXED_COLUMNS:
            out = out.withColumn(POSITION_NAMES[c], F.col(f"_dep_{c}"))
    else:
        out = joined.withColumn("platform", F.col("_dep_platform_name"))
    if keep_dep_ord:
        out = out.withColumn("dep_ord", F.col("_dep_ord"))
    return out.drop(*[c for c in out.columns if c.startswith("_dep_")])


def attach_deployments_bucketed(obs: DataFrame, deployments: DataFrame, coverage: DataFrame, platform_type: str = "fixed",
                                bucket: str = "month", keep_dep_ord: bool = False) -> DataFrame:
    """Same result as ``attach_deployments`` for very large deployment tables.

    Each deployment is expanded to the time buckets its window touches (open
    windows up to the end of the dataset's data in ``coverage``, the index's
    dataset_id and data_end), then the join is an equi-join on ``(dataset_id,
    bucket)`` plus the window as a residual. Neither side needs a per-dataset
    window, so one huge station spreads over all tasks, and ``obs`` is read once.
    """
    last = coverage.select("dataset_id", F.col("data_end").alias("_last"))
    deps = deployments.join(broadcast_if_small(last), on="dataset_id", how="inner")
    # buckets only up to the dataset's last reading: bounded by the data span
    upper = F.least(F.coalesce(F.col("end"), F.col("_last")), F.greatest(F.col("_last"), F.col("start")))
    lo = F.date_trunc(bucket, F.col("start")).cast("timestamp_ntz")
    hi = F.date_trunc(bucket, upper).cast("timestamp_ntz")
    step = F.expr(f"INTERVAL 1 {bucket.upper()}")
    deps = deps.withColumn("_bucket", F.explode(F.sequence(lo, hi, step)))
    if platform_type == "fixed":
        payload = [F.col(c).alias(f"_dep_{c}") for c in FIXED_COLUMNS]
    else:
        payload = [F.col("platform_name").alias("_dep_platform_name")]
    deps = deps.select(
        F.col("dataset_id").alias("_dep_ds"), F.col("_bucket").alias("_dep_bucket"),
        F.col("start").alias("_dep_start"), F.col("end").alias("_dep_end"),
        F.col("dep_ord").alias("_dep_ord"), *payload,
    )
    obs_b = obs.withColumn("_obs_bucket", F.date_trunc(bucket, F.col("time")).cast("timestamp_ntz"))
    cond = (
        (F.col("dataset_id") == F.col("_dep_ds"))
        & (F.col("_obs_bucket") == F.col("_dep_bucket"))
        & _in_window(F.col("time"), F.col("_dep_start"), F.col("_dep_end"))
    )
    joined = obs_b.join(deps, on=cond, how="left")
    if platform_type == "fixed":
        out = joined
        for c in FIXED_COLUMNS:
            out = out.withColumn(POSITION_NAMES[c], F.col(f"_dep_{c}"))
    else:
        out = joined.withColumn("platform", F.col("_dep_platform_name"))
    if keep_dep_ord:
        out = out.withColumn("dep_ord", F.col("_dep_ord"))
    return out.drop("_obs_bucket", *[c for c in out.columns if c.startswith("_dep_")])


def current_position(deployments: DataFrame, now: datetime | str) -> DataFrame:
    """Per dataset: the first deployment active at ``now``, else the last one
    (even if it has ended or not begun)."""
    now_c = ts_lit(now)
    active = _in_window(now_c, F.col("start"), F.col("end"))
    w = Window.partitionBy("dataset_id").orderBy(
        active.desc(), F.when(active, F.col("dep_ord")).otherwise(-F.col("dep_ord")).asc()
    )
    return (
        deployments.withColumn("_active", active)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .select("dataset_id", "dep_ord", F.col("_active").alias("active"), "lat", "lon", "elevation")
    )
