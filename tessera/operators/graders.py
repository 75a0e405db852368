"""Grading of samples by models of several tiers, in one plan.

Every sample meets every tier; a tier names how its model is reached and the
factory of its adapter. Replies are parsed by built-in expressions, and a call
that fails, a reply without scores or a tier of unknown kind gives the fallback
scores in place of an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.models import Adapter
from tessera.operators.scoring import with_fallback

#: How a model is reached: a service takes calls side by side, a model in the worker takes batches.
KINDS = {"api": True, "local": False, "hub": False}
BEST = "sota"


@dataclass(frozen=True)
class Tier:
    capability: str
    kind: str
    adapter: Callable[[], Adapter]
    batch: int = 16
    in_flight: int = 4


def chat_batch(adapter: Adapter, prompts: list[str], side_by_side: bool, batch: int, in_flight: int) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt; a batch that fails is asked again prompt by prompt, so that one bad prompt costs one reply."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return adapter.generate([prompt])[0], None
        except Exception as e:  # the error is this prompt's result
            return None, f"{type(e).__name__}: {e}"

    if side_by_side:
        with ThreadPoolExecutor(in_flight) as pool:
            return list(pool.map(one, prompts))
    out: list[tuple[str | None, str | None]] = []
    for start in range(0, len(prompts), batch):
        part = prompts[start : start + batch]
        try:
            replies = adapter.generate(part)
            if len(replies) != len(part):
                raise ValueError(f"{len(replies)} replies for {len(part)} prompts")
            out += [(r, None) for r in replies]
        except Exception:
            out += [one(p) for p in part]
    return out


def replies(samples: DataFrame, tiers: list[Tier], id_col: str = "sample_id", prompt: str = "prompt", all_tiers: bool = True, tasks: int = 8) -> DataFrame:
    """(sample_id, cap, reply, error) of every sample and tier, or of the best tier only.

    A task holds a partition of the samples and one tier, so that a worker loads
    one model and no task grows with the table; fewer partitions than ``tasks`` are dealt anew.
    """
    asked = [x for x in tiers if all_tiers or x.capability == BEST]
    by_name = {x.capability: x for x in asked}
    kind = samples.schema[id_col].dataType.simpleString()
    rows = samples.select(F.col(id_col).alias("sample_id"), F.col(prompt).alias("prompt"))
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Adapter | Exception] = {}
        for frame in frames:
            for cap, part in frame.groupby("cap", sort=False):
                tier = by_name[cap]
                if cap not in ready:
                    try:
                        if tier.kind not in KINDS:
                            raise ValueError(f"unknown kind of model {tier.kind!r}")
                        ready[cap] = tier.adapter()
                        ready[cap].load()
                    except Exception as e:
                        ready[cap] = e
                adapter = ready[cap]
                if isinstance(adapter, Exception):
                    found = [(None, f"{type(adapter).__name__}: {adapter}")] * len(part)
                else:
                    found = chat_batch(adapter, part["prompt"].tolist(), KINDS[tier.kind], tier.batch, tier.in_flight)
                yield pd.DataFrame({"sample_id": part["sample_id"], "cap": cap, "reply": [r for r, _ in found], "error": [e for _, e in found]})

    out = [rows.withColumn("cap", F.lit(x.capability)).mapInPandas(run, f"sample_id {kind}, cap string, reply string, error string") for x in asked]
    if not out:
        return rows.limit(0).select("sample_id", *[F.lit(None).cast("string").alias(c) for c in ("cap", "reply", "error")])
    return reduce(DataFrame.unionByName, out)


_REPLY = "correctness_score double, correctness_confidence double, training_quality_score double, training_quality_confidence double, recommended_metrics array<string>"


def grades(answered: DataFrame) -> DataFrame:
    """(sample_id, cap, corr, corr_conf, train, train_conf, n_metrics, is_fallback, error) of replies.

    A reply counts if it has both scores; a confidence that is missing is 0.5.
    """
    parsed = answered.withColumn("r", F.from_json(t.reply_json(F.col("reply")), _REPLY))
    whole = F.col("r.correctness_score").isNotNull() & F.col("r.training_quality_score").isNotNull()
    score = lambda c: F.when(whole, F.col(f"r.{c}"))
    rows = parsed.select(
        "sample_id", "cap", score("correctness_score").alias("corr"), score("correctness_confidence").alias("corr_conf"), score("training_quality_score").alias("train"),
        score("training_quality_confidence").alias("train_conf"), F.when(whole, F.size(F.coalesce("r.recommended_metrics", F.array().cast("array<string>")))).otherwise(0).alias("n_metrics"), "error",
    )
    return with_fallback(rows)


def evaluate(samples: DataFrame, tiers: list[Tier], id_col: str = "sample_id", prompt: str = "prompt", all_tiers: bool = True, tasks: int = 8) -> DataFrame:
    """The grades of every sample by every tier (or the best one), failures as fallback rows."""
    return grades(replies(samples, tiers, id_col, prompt, all_tiers, tasks))
