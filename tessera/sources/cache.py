"""Feature tables that are filled batch by batch and go on where they stopped.

A cache is a Parquet table with a folder for each batch, and a manifest, which
names a batch once its rows are written. A write replaces the batches it has
rows of and no others, so a batch may be written again at any time; one whose
write broke off isn't in the manifest and is made anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FeatureCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, part: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"{name!r} can't name a cache")
        return f"{self.root}/{name}/{part}"

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def manifest(self, name: str) -> DataFrame:
        """(batch, rows) of the batches that are written."""
        path = self._path(name, "manifest")
        if not self._exists(path):
            return self.spark.createDataFrame([], "batch long, rows long")
        return self.spark.read.schema("rows long, batch long").parquet(path).select("batch", "rows")

    def write(self, name: str, rows: DataFrame, batches: DataFrame | None = None) -> None:
        """Write the batches that ``rows`` (with ``batch`` long) has, in place of what they held.

        ``batches`` (batch) names those that are done by this; by default those with rows.
        One that is named and has no rows keeps those it held.
        """
        replace = lambda df, part: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self._path(name, part))
        asked = (rows if batches is None else batches).select("batch").distinct()
        replace(rows, "rows")
        # Counted in what stands in the table, not in what was to be written.
        found = self.spark.read.schema(rows.schema).parquet(self._path(name, "rows")) if self._exists(self._path(name, "rows")) else rows.limit(0)
        counts = found.join(asked, "batch", "left_semi").groupBy("batch").agg(F.count("*").alias("rows"))
        replace(asked.join(counts, "batch", "left").select(F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "batch"), "manifest")

    def missing(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows whose batch isn't written yet."""
        done = self.manifest(name).select(F.col("batch").alias("_done"))
        return rows.join(done, F.col("batch") == F.col("_done"), "left_anti")

    def fill(self, name: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], jobs: int = 8) -> int:
        """Make and write the batches of ``rows`` that are missing, in at most ``jobs`` jobs by ranges of batches; gives the number of jobs.

        ``make`` keeps the column ``batch``; if it fails, the ranges before are kept.
        """
        ends = self.missing(name, rows).agg(F.min("batch").alias("a"), F.max("batch").alias("b")).first()
        if ends.a is None:
            return 0
        width, done = -(-(ends.b - ends.a + 1) // jobs), 0
        for low in range(ends.a, ends.b + 1, width):
            part = self.missing(name, rows.where(F.col("batch").between(low, low + width - 1)))
            if part.isEmpty():
                continue
            self.write(name, make(part), part)
            done += 1
        return done

    def read(self, name: str) -> DataFrame:
        """All rows that are written and named by the manifest."""
        path = self._path(name, "rows")
        if not self._exists(path):
            raise FileNotFoundError(f"no cache {name!r} in {self.root}")
        done = self.manifest(name).select(F.col("batch").alias("_done"))
        rows = self.spark.read.parquet(path)
        return rows.withColumn("batch", F.col("batch").cast("long")).join(done, F.col("batch") == F.col("_done"), "left_semi")

    def delete(self, name: str) -> bool:
        """Drop a cache; false if there was none."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name, "").rstrip("/"))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
