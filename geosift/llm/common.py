"""What the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geosift.staging import new_path, release, scratch_dir, small, stage, temporary, unstage, unused

__all__ = ["ascii_lower", "new_path", "qualified", "release", "row_key", "scratch_dir", "small", "small_batches", "stage", "temporary", "unstage", "unused"]

#: Rows and bytes of an Arrow batch at most: texts may be long, and a batch is held several times on its way.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
#: Rows that a Parquet reader decodes at a time: of whole texts or sets, Spark's 4,096 are arrays of many MB, made anew as they grow.
READ_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, and the batches of its Parquet readers, if they are larger."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(id_col: str, text_col: str) -> Column:
    """A key of (id, text) that is never null: rows that agree in both are the same document."""
    return F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.lit("\n"),
                           F.coalesce(F.concat(F.lit("t"), F.col(text_col)), F.lit("n"))), 256)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system: one without a scheme is in Spark's default one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)
