"""Model versions and checkpoints on a file system: records are JSON files, models are folders.

Files are handled through Hadoop's file system, so a registry may lie where all
executors can read it.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera import schemas
from tessera.operators import history

CHECKPOINT = "epoch bigint, loss double, path string"


class Store:
    """Small files and folders below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name if "/" in name and name.startswith(("/", "file:", "hdfs:", "s3")) else f"{self.root}/{name}")

    def fs(self, name: str = ""):
        return self.path(name or ".").getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self.fs(name).exists(self.path(name))

    def put(self, name: str, record: dict) -> None:
        """Write a record beside its place and move it there, so that no reader sees half of it."""
        target, beside = self.path(name), self.path(f"{name}.new")
        fs = self.fs(name)
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(record, ensure_ascii=False).encode()))
        out.close()
        fs.delete(target, False)
        if not fs.rename(beside, target):
            raise OSError(f"cannot write {name}")

    def copy(self, source: str, name: str) -> None:
        a, b = self.path(source), self.path(name)
        self.fs(name).delete(b, True)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs(source), a, self.fs(name), b, False, True, self.conf)

    def remove(self, name: str) -> bool:
        return self.fs(name).delete(self.path(name), True)

    def records(self, folder: str, schema: str) -> DataFrame:
        """All records of a folder; none if there is no folder."""
        fields = T.StructType.fromDDL(schema)
        found = self.fs().globStatus(self.path(f"{folder}/*.json")) if self.exists(folder) else None
        if not found:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).json([str(x.getPath().toString()) for x in found])


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The registered versions."""
    return Store(spark, root).records("versions", schemas.MODEL_VERSION)


def register_version(spark: SparkSession, root: str, model_path: str, day: str, **record) -> str:
    """Copy a model folder into the registry under the day's next version and write its record."""
    store = Store(spark, root)
    name = history.next_version(versions(spark, root), day).first()["version"]
    store.copy(model_path, f"models/{name}")
    made = {"created_at": datetime.now(timezone.utc).isoformat(), "metadata": {}} | record
    store.put(f"versions/{name}.json", made | {"version": name, "model_path": f"{store.root}/models/{name}"})
    return name


def delete_version(spark: SparkSession, root: str, version: str) -> bool:
    """Delete a version's record and model; False if there is none."""
    store = Store(spark, root)
    if not store.remove(f"versions/{version}.json"):
        return False
    store.remove(f"models/{version}")
    return True


def checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(epoch, loss, path) of the saved checkpoints."""
    return Store(spark, root).records("index", CHECKPOINT)


def save_checkpoint(spark: SparkSession, root: str, source: str, epoch: int, loss: float, keep: int = 3) -> list[int]:
    """Copy a checkpoint in, refresh the copy of the best one, and leave the ``keep`` best; gives their epochs."""
    store = Store(spark, root)
    name = f"epoch_{epoch:05d}"
    store.copy(source, name)
    store.put(f"index/{name}.json", {"epoch": epoch, "loss": loss, "path": f"{store.root}/{name}"})
    # One row for each checkpoint that is still there: at most keep + 1.
    ranked = history.kept_checkpoints(checkpoints(spark, root).selectExpr("1 AS run", "epoch", "loss AS val_loss"), keep + 1).collect()
    ranked = sorted(ranked, key=lambda r: r["rank"])
    for row in ranked[keep:]:
        store.remove(f"epoch_{row['epoch']:05d}")
        store.remove(f"index/epoch_{row['epoch']:05d}.json")
    if ranked and ranked[0]["epoch"] == epoch:
        store.copy(name, "best")
    return [r["epoch"] for r in ranked[:keep]]
