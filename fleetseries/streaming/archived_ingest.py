"""Incremental ingest of closed (archived) logger files with Structured Streaming.

Archived files never change once written, which is exactly the contract of the
streaming file source: every new file is delivered once, and the checkpoint
remembers what was read. The stream carries file names and sizes only; each
micro-batch reads the heads and byte ranges of its own files and writes rows
and rejects to a folder per batch id, so a retried batch replaces its own
output instead of duplicating it.

Live files grow in place, which a file stream would miss; they stay on the
batch path (index refresh by change token, ``operators.index``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseries.operators.reconcile import is_archived
from fleetseries.schemas import HISTORICAL_SUFFIX
from fleetseries.session import new_scratch_path, write_table
from fleetseries.sources import logger_files as lf

LISTING = "path string, modificationTime timestamp, length long, content binary"


def _batch_writer(bronze_path: str, timestamp_column: str, dataset_of: Callable) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        headers = write_table(lf.scan_headers(batch), "file_headers")
        rows, rejects = lf.ingest(headers, new_scratch_path(batch.sparkSession, "archived"), dataset_of, timestamp_column)
        base = bronze_path.rstrip("/")
        rejects.write.mode("overwrite").parquet(f"{base}/rejects/batch_id={batch_id}")
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")
    return write


def start_archived_ingest(spark: SparkSession, source_dir: str, bronze_path: str, checkpoint_path: str,
                          timestamp_column: str = "TIMESTAMP", historical_suffix: str = HISTORICAL_SUFFIX,
                          max_files_per_trigger: int = 1000, dataset_of: Callable | None = None):
    """Start (``availableNow``) the ingest of archived files by either naming rule
    (the suffix, or a ``.backup`` extension); returns the StreamingQuery.

    Rows land below ``bronze_path``/rows, rejected lines below ``bronze_path``/rejects.
    """
    dataset_of = dataset_of or (lambda c: F.regexp_extract(c, r"/([^/]+)/[^/]+$", 1))
    stream = (spark.readStream.format("binaryFile").schema(LISTING)
              .option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .load(source_dir)
              .select(F.col("path").alias("file_name"), F.col("length").alias("size"))
              .filter(is_archived(F.col("file_name"), historical_suffix)))
    return (stream.writeStream
            .foreachBatch(_batch_writer(bronze_path, timestamp_column, dataset_of))
            .option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True)
            .start())
