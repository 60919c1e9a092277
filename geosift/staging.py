"""Staging tables in the cluster's shared folder, and broadcasts behind a check of size."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few hundred bytes a row) may be broadcast.
BROADCAST_ROWS = 100_000

_own: dict[str, str] = {}  # application -> its folder, where no shared one is set
_open: ContextVar[tuple[list[str], ...]] = ContextVar("staged", default=())  # the tables of each open `temporary`


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only on a local master where the setting is absent."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="geosift-")
    return _own[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/geosift/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    keep: the table outlives the innermost `temporary` (it belongs to the one around that, if any).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    owners = _open.get()[:-1] if keep else _open.get()
    if owners:
        owners[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the table of a DataFrame that `stage` returned: nothing that is still to run may read it."""
    delete(df.sparkSession, df._staged_path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are done: they go when the driver's garbage does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but those to keep: no DataFrame that leaves may read another one."""
    tables: list[str] = []
    token = _open.set((*_open.get(), tables))
    try:
        yield
    finally:
        _open.reset(token)
        for path in tables:
            delete(spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is (Spark then shuffles).

    The count stops at rows + 1, so the check costs no more than the table it allows.
    """
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def unused(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the tables has, whatever their case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
