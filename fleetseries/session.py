"""Session defaults and the shared scratch folder.

Every operator in this package is a plain ``DataFrame -> DataFrame`` function
without actions; this module only carries the settings those plans rely on:
UTC session time, ANSI mode, adaptive execution (runtime broadcast decisions
and skew splitting), and the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings the operators assume. Applied with ``configure`` on an
# existing session (only the SQL settings, which are runtime-modifiable).
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # pivot value lists are always passed explicitly; this only guards misuse
    "spark.sql.pivotMaxValues": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benchmarks (UI off, event log off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetseries")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for written intermediate tables.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Where
    neither is set, a session in local mode (tests: driver and executors are one
    process) gets a folder of its own; on a cluster that is an error, because
    executors would write to their own disks.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    try:
        ctx_dir = spark.sparkContext.getCheckpointDir()
    except Exception:  # no JVM handle (remote session): rely on the conf only
        ctx_dir = None
    if ctx_dir:
        return ctx_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="fleetseries-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder; ``parts`` name a stable location."""
    return "/".join([shared_dir(spark), "fleetseries", *parts])


def new_scratch_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside lambdas Spark computes an expression at each place that names it."""
    return F.transform(F.array(value), body)[0]


def _lit(value, dtype):
    from pyspark.sql import types as T

    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.ArrayType):
        if not value:
            return F.array().cast(dtype)
        return F.array(*[_lit(v, dtype.elementType) for v in value])
    if isinstance(dtype, T.StructType):
        return F.struct(*[_lit(v, f.dataType).alias(f.name) for v, f in zip(value, dtype.fields)])
    return F.lit(value).cast(dtype)


def literal_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A small table of literal rows (configuration: a few rows, bounded).

    Built as ``inline`` of a literal array over a one-row range, so the
    planner sees a tiny relation (``createDataFrame`` of local data gives an
    RDD relation whose size is unknown, which would defeat size-checked
    broadcasts).
    """
    from pyspark.sql import types as T

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], schema)
    arr = F.array(*[_lit(tuple(r), schema) for r in rows])
    return spark.range(1).select(F.inline(arr))


#: Shuffle files of a query go with its end, not when the driver's memory is next collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write a (small, derived) table into the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, and the re-read table carries
    its real on-disk size, so a later size-checked broadcast decision rests
    on measured bytes instead of a join-product estimate. The shuffle files
    of the write go at its end, as only the table is read again.
    """
    spark = df.sparkSession
    path = new_scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete what ``write_table`` wrote for ``table``, once nothing reads it any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        if folder.getParent().getName() != "fleetseries":
            raise ValueError(f"not a table of the shared folder: {folder}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark names files below it."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toString()


def _folder(spark: SparkSession, path: str) -> tuple:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def empty_folder(spark: SparkSession, path: str) -> None:
    """Delete what is at a path, and make an empty folder there."""
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)
    fs.mkdirs(folder)


def mark_complete(spark: SparkSession, path: str) -> None:
    """The empty file that Spark's own writers leave in a folder once all is written."""
    fs, folder = _folder(spark, path)
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")).close()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (any scheme)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover - estimate unavailable
        return None


#: The driver builds a broadcast table as hashed rows, several times the bytes counted here, and several at a time.
DEFAULT_BROADCAST_BYTES = 8 * 1024 * 1024
#: What an estimate may fall short of: files are compressed, and ``explode`` is not counted.
ESTIMATE_SLACK = 8


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the planner's size estimate, ``ESTIMATE_SLACK`` times over, is under ``max_bytes``.

    Beyond the bound there is no hint: a shuffle join is planned, and adaptive
    execution turns it into a broadcast where the measured size allows.
    """
    size = estimated_bytes(df)
    if size is not None and size * ESTIMATE_SLACK <= max_bytes:
        return F.broadcast(df)
    return df
