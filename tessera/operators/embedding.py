"""Embeddings from a service: batched calls, bounded concurrency, retries, and a store of what is known.

Each different text is asked for once, over all tables and runs that share a
store: texts are keyed by hash, and those that the store has are left out before
any call. A text that could not be embedded has a null vector and the error, and
is asked for again next time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.agents import FatalError

_ROW = "key string, embedding array<double>, error string"


@dataclass(frozen=True)
class Client:
    """``encode`` maps a list of texts to as many vectors.

    A task has ``in_flight`` calls of ``batch`` texts under way at most; a call
    that fails is tried ``retries`` times more, after ``pause`` * 2^attempt
    seconds. A ``FatalError`` isn't tried again.
    """

    encode: Callable[[list[str]], list[list[float]]]
    model: str
    batch: int = 100
    in_flight: int = 4
    retries: int = 2
    pause: float = 1.0

    def call(self, texts: list[str]) -> tuple[list[list[float] | None], str | None]:
        error = None
        for attempt in range(self.retries + 1):
            try:
                found = [[float(x) for x in v] for v in self.encode(texts)]
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return list(found), None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if isinstance(e, FatalError) or attempt == self.retries:
                    break
                time.sleep(self.pause * 2**attempt)
        return [None] * len(texts), error

    def calls(self, texts: list[str]) -> Iterator[tuple[list[float] | None, str | None]]:
        """A vector, or an error, for each text in order."""
        parts = [texts[k : k + self.batch] for k in range(0, len(texts), self.batch)]
        with ThreadPoolExecutor(self.in_flight) as pool:
            for vectors, error in pool.map(self.call, parts):
                yield from ((v, error) for v in vectors)


class Store:
    """Vectors by model and text hash, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, model: str) -> str:
        return f"{self.root}/{''.join(c if c.isalnum() or c in '-.' else '_' for c in model)}"

    def known(self, model: str) -> DataFrame:
        """(key, embedding, error) of all calls so far; a key whose call failed may stand there again."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(model))
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(self._path(model))

    def fill(self, texts: DataFrame, column: str, client: Client, tasks: int = 8) -> None:
        """Ask for the texts that aren't known, from ``tasks`` tasks at once."""
        different = texts.where(F.col(column).isNotNull()).groupBy(key_of(column).alias("key")).agg(F.first(column).alias("text"))
        done = self.known(client.model).where("embedding IS NOT NULL").select("key")
        asked = different.join(done, "key", "left_anti").repartition(tasks, "key")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = list(client.calls(frame["text"].tolist()))
                yield pd.DataFrame({"key": frame["key"], "embedding": [v for v, _ in found], "error": [e for _, e in found]})

        asked.mapInPandas(run, _ROW).write.mode("append").parquet(self._path(client.model))

    def embed(self, texts: DataFrame, column: str, client: Client, tasks: int = 8) -> DataFrame:
        """``texts`` with ``embedding`` and ``error``, which is null where there is a vector or no text."""
        self.fill(texts, column, client, tasks)
        # Two tasks can have stored a key; of errors the last by name says as much as any.
        best = self.known(client.model).groupBy(F.col("key").alias("_key")).agg(F.first("embedding", ignorenulls=True).alias("embedding"), F.max("error").alias("_error"))
        joined = texts.withColumn("_text", key_of(column)).join(best, F.col("_text") == F.col("_key"), "left")
        return joined.withColumn("error", F.when(F.col("embedding").isNull(), F.col("_error"))).drop("_text", "_key", "_error")


def key_of(column: str):
    return F.sha2(F.col(column), 256)
