"""Mobile platform tracks and latest positions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseries.functions.scalar import ts_lit

TRACK_LOOKBACK = timedelta(days=7)


def valid_points(positions: DataFrame) -> DataFrame:
    """Points with both latitude and longitude present."""
    return positions.dropna(subset=["latitude", "longitude"])


def recent_track(positions: DataFrame, now: datetime | str, lookback: timedelta = TRACK_LOOKBACK) -> DataFrame:
    """Valid points from ``now - lookback`` on (start inclusive)."""
    if isinstance(now, str):
        now = datetime.fromisoformat(now)
    return valid_points(positions).filter(F.col("time") >= ts_lit(now - lookback))


def latest_position(positions: DataFrame) -> DataFrame:
    """Last valid point per dataset (``max_by``: partial aggregation per task)."""
    return valid_points(positions).groupBy("dataset_id").agg(
        F.max("time").alias("time"),
        F.max_by(F.struct("latitude", "longitude"), F.col("time")).alias("p"),
        F.count(F.lit(1)).alias("n_points"),
    ).select("dataset_id", "time", "p.latitude", "p.longitude", "n_points")
