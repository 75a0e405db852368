"""Where intermediate tables live: always in the folder that driver and executors share.

Tables are bounded by their input, may be empty, and keep nulls, repeated rows
and column names as they come; texts of any length are plain Parquet values.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.workdir import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_flip = threading.RLock()
_open = threading.local()


def write_table(df: DataFrame, label: str) -> str:
    """Write ``df`` as Parquet under the shared folder; gives the path.

    The write's own shuffle files go when it is done, where this Spark can do
    so: what follows reads the table. The setting for that is the session's, so
    one write of this module runs at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"
    for tables in getattr(_open, "scopes", []):
        tables.append(path)
    if not spark.conf.isModifiable(_CLEANUP):
        df.write.parquet(path)
        return path
    with _flip:
        before = spark.conf.get(_CLEANUP)
        try:
            spark.conf.set(_CLEANUP, "true")
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    return path


def read_table(df: DataFrame, path: str) -> DataFrame:
    """A table that was written from ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of a file, never a
    recomputation, and range partitioning may sample the result cheaply.
    """
    return read_table(df, write_table(df, label))


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession):
    """Delete every table that was written inside, at the end; only for results that are written elsewhere by then.

    Gives a function that excepts a path from this.
    """
    scopes = _open.scopes = getattr(_open, "scopes", [])
    tables: list[str] = []
    scopes.append(tables)
    try:
        yield tables.remove
    finally:
        scopes[:] = [x for x in scopes if x is not tables]
        for path in tables:
            remove_table(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most 2048 rows and 16 MB, where the session has Spark's own limits.

    Whole texts pass through Python in batches; this bounds what a worker and
    its JVM hold of them at once. It is a setting of the session and stays, for
    results are computed when they are asked for; the registered queries call
    it, operators don't.
    """
    for key, default, value in (("maxRecordsPerBatch", "10000", "2048"), ("maxBytesPerBatch", "67108864", "16777216")):
        name = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(name, default)).rstrip("b") == default:
            spark.conf.set(name, value)
