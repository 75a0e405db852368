"""The folder for intermediate tables: the one that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; it becomes the context's checkpoint folder.

    Where that setting is absent and everything runs in one JVM (master
    ``local``, as in tests) a fresh local folder is made. On a cluster executors
    would write to disks of their own, so its absence is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tessera_dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: with master {sc.master!r} it must name a folder that driver and executors share")
        named = sc._tessera_dir = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="tessera-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder, which cuts its lineage; unlike ``checkpoint()`` it is computed once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Adds each row's place from 0 in the order of all rows, which are sorted by ranges; one row for each range is summed up."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = ranged.groupBy(F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranged.join(F.broadcast(parts.withColumn("_before", before)), F.col("_part") == F.col("_p"))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_p", "_first", "_n", "_before")
