"""Models and benchmarks by name: adapters that answer batches of prompts, and sources of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.operators.agents import FatalError, with_retries


class Adapter(Protocol):
    """What answers prompts. ``load`` runs once in each worker process before ``generate``."""

    def load(self) -> None: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoAdapter:
    """Stands in where no model is at hand: repeats the end of the prompt."""

    def __init__(self, most: int = 200):
        self.most, self.loaded = most, False

    def load(self) -> None:
        self.loaded = True

    def generate(self, prompts: list[str]) -> list[str]:
        return [p[-self.most :] for p in prompts]


class CallAdapter:
    """Wraps a function of one prompt; a call that fails is tried again."""

    def __init__(self, call: Callable[[str], str], retries: int = 2, pause: float = 1.5):
        self.call = with_retries(lambda _, prompt: {"text": call(prompt)}, retries, pause)

    def load(self) -> None:
        return None

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.call("", p)["text"] for p in prompts]


@dataclass
class Registry:
    """Factories by name."""

    what: str
    known: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, factory: Callable, replace: bool = False) -> None:
        if name in self.known and not replace:
            raise ValueError(f"{self.what} {name!r} is registered")
        self.known[name] = factory

    def names(self) -> list[str]:
        return sorted(self.known)

    def get(self, name: str, **settings):
        if name not in self.known:
            raise KeyError(f"unknown {self.what} {name!r}; known: {', '.join(self.names())}")
        return self.known[name](**settings)


ADAPTERS = Registry("model adapter")
ADAPTERS.register("echo", EchoAdapter)
ADAPTERS.register("call", CallAdapter)


def generate(tasks: DataFrame, adapter: Callable[[], Adapter], prompt: str = "question", batch: int = 32) -> DataFrame:
    """Adds ``answer`` and ``error``: each prompt's reply, ``batch`` prompts at a time.

    A worker makes and loads its own adapter. If a batch fails its prompts are
    tried one by one, and only those that fail carry an error.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tasks.schema)}, answer string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = adapter()
        model.load()

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return model.generate([text])[0], None
            except Exception as e:
                return None, str(e)

        for frame in frames:
            replies: list[tuple[str | None, str | None]] = []
            prompts = frame[prompt].fillna("").tolist()
            for start in range(0, len(prompts), batch):
                part = prompts[start : start + batch]
                try:
                    found = model.generate(part)
                    if len(found) != len(part):
                        raise FatalError("the adapter gave another number of replies")
                    replies += [(x, None) for x in found]
                except Exception:
                    replies += [one(x) for x in part]
            yield frame.assign(answer=[x[0] for x in replies], error=[x[1] for x in replies])

    return tasks.mapInPandas(run, schema)


@dataclass
class Benchmark:
    """Where a benchmark's items come from and how they become tasks."""

    name: str
    items: Callable[[SparkSession], DataFrame]
    ordinal: str
    taxonomy: tuple[str, ...] = ()
    extras: tuple[str, ...] = ()


@dataclass
class BenchmarkManager:
    """Benchmarks by name, with their taxonomy fields."""

    known: dict[str, Benchmark] = field(default_factory=dict)

    def register(self, benchmark: Benchmark) -> None:
        self.known[benchmark.name] = benchmark

    def names(self, fields: list[str] | None = None) -> list[str]:
        """All names, or of those with any of the taxonomy fields."""
        return sorted(n for n, b in self.known.items() if not fields or set(fields) & set(b.taxonomy))

    def load(self, spark: SparkSession, name: str, most: int | None = None) -> DataFrame:
        """(benchmark, task_id, question, image, ground_truth, metadata) of a benchmark, at most so many by ordinal."""
        if name not in self.known:
            raise KeyError(f"unknown benchmark {name!r}; known: {', '.join(self.names())}")
        b = self.known[name]
        items = b.items(spark)
        items = items.orderBy(b.ordinal).limit(most) if most is not None else items
        return evaluation.to_tasks(items, b.ordinal, list(b.taxonomy), list(b.extras)).select(F.lit(name).alias("benchmark"), "*")

    def evaluate(self, spark: SparkSession, names: list[str], adapter: Callable[[], Adapter], most: int | None = None) -> DataFrame:
        """Answers, scores and status of all tasks of the named benchmarks."""
        tasks = None
        for name in names:
            own = self.load(spark, name, most)
            tasks = own if tasks is None else tasks.unionByName(own)
        if tasks is None:
            raise ValueError("no benchmark is named")
        answered = generate(tasks, adapter)
        status = F.when(F.col("error").isNotNull(), "error").when(F.col("ground_truth").isNull(), "skipped").otherwise("ok")
        scored = evaluation.scored_answers(answered.withColumn("answer", F.coalesce("answer", F.lit(""))))
        return scored.withColumns({"status": status, "score": F.coalesce("score", F.lit(0.0)), "is_correct": F.coalesce("is_correct", F.lit(False))})
