"""Telemetry tables: long (device, key, ts_ms, value) rows.

The per-key series of a device are aligned on time in one grouping with an
explicit key list. No point cap: every reading in the window is returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetseries.functions.scalar import parse_number, ts_lit


def with_time(tele: DataFrame) -> DataFrame:
    """Epoch milliseconds -> naive UTC ``time`` (session zone is UTC)."""
    return tele.withColumn("time", F.timestamp_millis("ts_ms").cast("timestamp_ntz"))


def select_window(tele: DataFrame, keys: Sequence[str] | None, start: datetime | None,
                  end: datetime | None) -> DataFrame:
    """Key list and inclusive time range, pushed to the scan as ``ts_ms`` bounds."""
    if keys is not None:
        tele = tele.filter(F.col("key").isin(list(keys)))
    if start is not None:
        tele = tele.filter(F.col("ts_ms") >= F.unix_millis(ts_lit(start).cast("timestamp")))
    if end is not None:
        tele = tele.filter(F.col("ts_ms") <= F.unix_millis(ts_lit(end).cast("timestamp")))
    return tele


def pivot_keys(tele: DataFrame, keys: Sequence[str], numeric: bool = True) -> DataFrame:
    """(device, time) rows with one column per key; a key without a reading at
    that instant is null, the greatest counts if a key repeats an instant. One
    grouping, so one shuffle, whatever the number of keys."""
    value = parse_number("value") if numeric else F.col("value")
    t = with_time(tele).withColumn("_v", value)
    return t.groupBy("device", "time").agg(*[F.max(F.when(F.col("key") == k, F.col("_v"))).alias(k) for k in keys])


def align_series(series: dict[str, DataFrame], numeric: bool = True) -> DataFrame:
    """Series of several keys, each a frame (device, ts_ms, value), aligned on time like a full outer join:
    a row for every instant of any series. They are stacked and grouped once instead of joined one by one."""
    stacked = [df.select("device", F.lit(key).alias("key"), "ts_ms", "value") for key, df in series.items()]
    return pivot_keys(reduce(DataFrame.unionByName, stacked), list(series), numeric)


def latest_per_key(tele: DataFrame) -> DataFrame:
    """Newest (ts, value) of every key of a device; the device's change token
    is the newest timestamp over its keys. Both are partial aggregates."""
    per_key = tele.groupBy("device", "key").agg(
        F.max("ts_ms").alias("last_ts_ms"),
        F.max_by("value", "ts_ms").alias("last_value"),
    )
    # one row per (device, key) after the aggregation: the window over a
    # device's keys is small, and it avoids a second aggregation plus a join
    return per_key.withColumn("change_token", F.max("last_ts_ms").over(Window.partitionBy("device")))
