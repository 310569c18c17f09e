"""Settled months and immutable monthly publishing."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetseries.functions.scalar import add_months_ntz, month_start, ts_lit
from fleetseries.schemas import SOFTWARE_VERSION
from fleetseries.session import path_exists
from fleetseries.sources.state import StateTable


def month_bounds(period_start: Column) -> tuple[Column, Column]:
    """First instant of the month and of the next month (timestamp_ntz)."""
    start = month_start(period_start)
    return start, add_months_ntz(start, 1)


def period_text(month_start_col: Column) -> Column:
    return F.date_format(month_start_col, "yyyy-MM")


def is_settled(month_start_col: Column, data_start: Column, data_end: Column, now: Column) -> Column:
    """Coverage exists, data starts before the month ends, and observed data
    (capped by the clock) reaches the month end."""
    _, month_end = month_bounds(month_start_col)
    return (
        data_start.isNotNull() & data_end.isNotNull()
        & (data_start < month_end)
        & (F.least(data_end, now) >= month_end)
    )


def latest_settled(coverage: DataFrame, now: datetime | str) -> DataFrame:
    """The month before ``least(data_end, now)``, if it is settled."""
    now_c = ts_lit(now)
    boundary = F.least(F.col("data_end"), now_c)
    prev_month = add_months_ntz(month_start(boundary), -1)
    settled = is_settled(prev_month, F.col("data_start"), F.col("data_end"), now_c)
    return coverage.select(
        "dataset_id",
        F.when(settled, period_text(prev_month)).alias("latest_complete_month"),
    )


def settled_months(coverage: DataFrame, now: datetime | str) -> DataFrame:
    """Every settled month per dataset: the months from the first reading's
    month up to the month before ``least(data_end, now)``. The sequence is
    bounded by the data span of each dataset."""
    now_c = ts_lit(now)
    first = month_start(F.col("data_start"))
    last = add_months_ntz(month_start(F.least(F.col("data_end"), now_c)), -1)
    months = coverage.filter(last >= first).select(
        "dataset_id", "data_start", "data_end",
        F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month_start"),
    ).withColumn("month_start", F.col("month_start").cast("timestamp_ntz"))
    months = months.filter(is_settled(F.col("month_start"), F.col("data_start"), F.col("data_end"), now_c))
    _, end = month_bounds(F.col("month_start"))
    return months.select("dataset_id", period_text(F.col("month_start")).alias("period"),
                         "month_start", end.alias("month_end"))


def publish_listing(catalog: DataFrame, coverage: DataFrame, now: datetime | str,
                    root: str = "") -> DataFrame:
    """Per publishable dataset: latest complete month and a locator."""
    pub = catalog.filter(F.col("publish")).select("dataset_id")
    latest = latest_settled(coverage, now)
    j = pub.join(latest, on="dataset_id", how="left")
    return j.withColumn(
        "download_url",
        F.when(F.col("latest_complete_month").isNotNull(),
               F.concat(F.lit(f"{root}/publish/"), F.col("dataset_id"), F.lit("/"),
                        F.col("latest_complete_month"))),
    )


def sorted_log(entries: DataFrame) -> DataFrame:
    """Log entries for a join. The log has a row per dataset and month in files that compress a hundredfold, so
    Spark would take it for small and build it in the driver."""
    return entries.hint("merge")


def pending_periods(settled: DataFrame, publish_log: DataFrame) -> DataFrame:
    """Settled periods not yet in the publish log (the log is the commit point)."""
    return settled.join(sorted_log(publish_log.select("dataset_id", "period")), on=["dataset_id", "period"],
                        how="left_anti")


def render_file_name(template: Column, station: Column, table: Column, month_start_col: Column) -> Column:
    """``{station} {table} {yyyy} {mm}`` placeholders filled in."""
    out = F.replace(template, F.lit("{station}"), station)
    out = F.replace(out, F.lit("{table}"), F.coalesce(table, F.lit("")))
    out = F.replace(out, F.lit("{yyyy}"), F.date_format(month_start_col, "yyyy"))
    return F.replace(out, F.lit("{mm}"), F.date_format(month_start_col, "MM"))


def select_month(built: DataFrame, pending: DataFrame, half_open: bool = False) -> DataFrame:
    """Rows of each pending month.

    Inclusive end by default: a reading exactly at midnight on the 1st belongs
    to both months, as in the reproduced behaviour. Each reading is keyed by
    its own month (and the previous month when it sits exactly on a month
    start), so the join is a plain equi-join on (dataset_id, month_start).
    """
    own = month_start(F.col("time"))
    keys = F.array(own)
    if not half_open:
        keys = F.when(F.col("time") == own, F.array(own, add_months_ntz(own, -1))).otherwise(keys)
    b = built.withColumn("month_start", F.explode(keys))
    p = pending.select("dataset_id", "period", "month_start", "month_end")
    return b.join(p, on=["dataset_id", "month_start"], how="inner")


LOG_SCHEMA = ("dataset_id string, period string, file_name string, n_rows bigint, config_hash string, "
              "software_version string, run string, created_at timestamp_ntz")


def publish_periods(built: DataFrame, settled: DataFrame, names: DataFrame, versions: DataFrame, log: StateTable,
                    data_root: str, now: datetime | str, run: str | None = None, half_open: bool = False) -> int:
    """Build and commit every settled month that the log does not have; returns the log's version.

    ``names`` has dataset_id and template (file naming), ``versions`` dataset_id and
    hash (current config). The rows of the pending months are written once, to a
    folder of this run; the log rows (one per dataset and month) are made from
    what was written and committed against the version that told what was
    pending. So a run that dies leaves nothing visible, a rerun publishes each
    month once, and of two runs at a time one fails (``ConcurrentUpdate``).
    """
    spark = built.sparkSession
    version = log.version()
    pending = pending_periods(settled, log.read(version))
    rows = select_month(built, pending, half_open).join(names, "dataset_id", "left")
    template = F.coalesce("template", F.lit("{station}_{yyyy}{mm}"))
    name = render_file_name(template, F.col("dataset_id"), F.lit(None).cast("string"), F.col("month_start"))
    rows = rows.withColumn("file_name", name).drop("template", "month_start", "month_end")
    run = run or uuid.uuid4().hex
    target = f"{data_root.rstrip('/')}/run={run}"
    # by month only: a folder per dataset and month would mean a tiny file each. Rebalancing cuts a
    # large month into several files; the order lets a read of one dataset skip row groups.
    ordered = rows.hint("rebalance", "period").sortWithinPartitions("period", "dataset_id", "time")
    ordered.write.mode("errorifexists").partitionBy("period").parquet(target)
    written = spark.read.schema(rows.schema).parquet(target).groupBy("dataset_id", "period").agg(
        F.min("file_name").alias("file_name"), F.count("*").alias("n_rows"))
    entries = written.join(versions.select("dataset_id", F.col("hash").alias("config_hash")), "dataset_id", "left").select(
        "dataset_id", "period", "file_name", "n_rows", "config_hash", F.lit(SOFTWARE_VERSION).alias("software_version"),
        F.lit(run).alias("run"), ts_lit(now).alias("created_at"))
    return log.append(entries, version)


def published_rows(log: StateTable, data_root: str, schema) -> DataFrame:
    """Rows of every committed month, read through the log (``schema``: the columns published)."""
    spark = log.spark
    done = log.read().select("dataset_id", "period", "run").distinct()
    if not path_exists(spark, data_root):
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    whole = T.StructType([*[f for f in schema.fields if f.name != "period"],
                          T.StructField("run", T.StringType()), T.StructField("period", T.StringType())])
    data = spark.read.schema(whole).parquet(data_root)
    return data.join(sorted_log(done), ["run", "dataset_id", "period"], "left_semi").select(*names)


def abandoned_runs(log: StateTable, data_root: str) -> DataFrame:
    """Runs whose folder exists but that the log does not name: they died, or are still writing."""
    spark = log.spark
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data_root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []  # one per run
    runs = spark.createDataFrame([(n.split("=", 1)[1],) for n in names if n.startswith("run=")], "run string")
    return runs.join(log.read().select("run").distinct(), "run", "left_anti")
