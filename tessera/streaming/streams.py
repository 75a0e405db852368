"""Streaming forms of the readers and of the benchmark run.

Every stream is a bounded set of files, taken with availableNow: a query ends
when they are done and goes on from its checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.evaluation import answer_score
from tessera.sources.readers import parsed_lines


def jsonl_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, skip_errors: bool = True) -> DataFrame:
    """JSON lines as a stream; bad lines are dropped, or raise if not ``skip_errors``."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not skip_errors:
        return spark.readStream.schema(wanted).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(path)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parsed_lines(lines, wanted).where(F.col("r._bad").isNull()).select("r.*").drop("_bad")


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def join_side(stream: DataFrame, side: DataFrame, key: str, side_key: str, order: list[str]) -> DataFrame:
    """Left join of a stream with the first row of each key of a static side; the side has no bound."""
    columns = [c for c in side.columns if c != side_key]
    firsts = side.groupBy(F.col(side_key).alias("_key")).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_first"))
    return stream.join(firsts, F.col(key) == F.col("_key"), "left").select(*stream.columns, *[F.col(f"_first.{c}").alias(c) for c in columns if c not in stream.columns])


def answers(tasks: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """(task_id, answer, error): an item that fails gives a row with its error and stops nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for task, question in frame[["task_id", "question"]].itertuples(index=False):
                try:
                    out.append((task, generate(question), None))
                except Exception as e:  # the error is this item's result
                    out.append((task, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["task_id", "answer", "error"])

    return tasks.select("task_id", "question").mapInPandas(run, "task_id string, answer string, error string")


def benchmark_rows(tasks: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """(task_id, answer, error, score, status): items without a question are skipped, failures score 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for task, question, truth in frame[["task_id", "question", "ground_truth"]].itertuples(index=False):
                if not question:
                    out.append((task, None, truth, None, "skipped"))
                    continue
                try:
                    out.append((task, generate(question), truth, None, "ok"))
                except Exception as e:
                    out.append((task, None, truth, f"{type(e).__name__}: {e}", "error"))
            yield pd.DataFrame(out, columns=["task_id", "answer", "ground_truth", "error", "status"])

    rows = tasks.select("task_id", "question", "ground_truth").mapInPandas(run, "task_id string, answer string, ground_truth string, error string, status string")
    return rows.withColumn("score", F.when(F.col("status") == "ok", answer_score(F.col("answer"), F.col("ground_truth"))).otherwise(0.0))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Take all there is, write it once each, and end."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
