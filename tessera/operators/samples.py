"""Nested dialogue samples: buffers to base64, cluster samples, prompts for graders and for the decision step."""

from __future__ import annotations

import ast
import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t


def buffer_base64(x: Column) -> Column:
    """Base64 of a buffer text: a bytes literal is decoded first, other text counts as base64; '' if it can't be read."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        def one(v):
            if not v:
                return ""
            if v[:2] in ("b'", 'b"'):
                try:
                    return base64.b64encode(ast.literal_eval(v)).decode()
                except (ValueError, SyntaxError):
                    return ""
            return v

        return values.map(one, na_action=None).fillna("")

    return convert(x)


def data_samples(clusters: DataFrame) -> DataFrame:
    """Samples of cluster rows (sample_id, cluster_id, data): filled buffers, full turns, kept metadata.

    A turn needs a question and an answer; without a turn, or an image, the
    field is null. Buffers are converted one row each, apart from the sample.
    """
    buffers = clusters.select("cluster_id", "sample_id", F.posexplode("data.image_buffer_list").alias("n", "b")).select("cluster_id", "sample_id", "n", buffer_base64(F.col("b.buffer")).alias("image"))
    images = buffers.where("image <> ''").groupBy(F.col("cluster_id").alias("c"), F.col("sample_id").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "image"))), lambda x: x["image"]).alias("image_base64"))
    turns = F.filter("data.dialogue", lambda x: t.not_empty(x["question"]).isNotNull() & t.not_empty(x["answer"]).isNotNull())
    full = clusters.join(images, (F.col("cluster_id") == F.col("c")) & (F.col("sample_id") == F.col("s")), "left")
    metadata = F.struct(F.col("cluster_id"), F.col("data.source").alias("source"), F.col("data.task_type").alias("task_type"), F.col("data.image_id_list").alias("image_id_list"))
    return full.select(F.col("sample_id").cast("string").alias("sample_id"), "image_base64", F.when(F.size(turns) > 0, turns).alias("dialogue"), metadata.alias("metadata"))


def caption_choice(captions: Column, key: Column, seed: int = 42) -> Column:
    """One of the captions, by a seeded hash of the key."""
    return F.element_at(captions, (F.pmod(F.xxhash64(F.lit(seed), key), F.size(captions).cast("long")) + 1).cast("int"))


def causal_text(instruction: Column, response: Column, text: Column) -> Column:
    return F.when(t.not_empty(instruction).isNotNull() & response.isNotNull(), F.concat(instruction, F.lit("\n\n"), response)).otherwise(text)


def grading_prompt(dialogue: Column, capability: Column, simple: bool = False) -> Column:
    """The request to grade a dialogue: numbered turns, the grader's part and the wanted JSON fields."""
    turns = F.array_join(F.transform(dialogue, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Q: "), F.coalesce(x["question"], F.lit("")), F.lit("\n   A: "), F.coalesce(x["answer"], F.lit("")))), "\n")
    fields = "correctness_score, training_quality_score (0 to 10)" if simple else "correctness_score, correctness_confidence, training_quality_score, training_quality_confidence, recommended_metrics, overall_assessment"
    return F.concat(F.lit("You grade as a "), capability, F.lit(" model.\n"), turns, F.lit(f"\nReply with one JSON object: {fields}."))


def metric_lines(merged: DataFrame, most: int = 12, specifics: int = 5) -> DataFrame:
    """The first metrics by position as lines of the decision prompt, each with its first specifics."""
    line = F.concat(F.lit("- "), F.col("general"), F.lit(": "), F.array_join(F.slice("specifics", 1, specifics), "; "))
    return merged.where(F.col("position") < most).select("grp", "position", line.alias("line"))


def hard_case_lines(hard: DataFrame, most: int = 3) -> DataFrame:
    """The first hard cases by sample id as lines with two decimals."""
    line = F.format_string("- sample %s: difficulty %.2f, confidence %.2f", F.col("sample_id").cast("string"), "difficulty", "confidence")
    return hard.orderBy("sample_id").limit(most).select("sample_id", line.alias("line"))


def decision_prompt(metrics: list[str], cases: list[str], agents: list[str], simple: bool = False) -> str:
    """The request to choose agents, from the lines above."""
    parts = ["Quality metrics:", *metrics, "", "Hard cases:", *(cases or ["- none"]), "", "Agents:", *agents, ""]
    end = "Name the agents to use." if simple else "Reply as <selection><reasoning>...</reasoning><agents><agent><name>...</name><prompt>...</prompt></agent></agents></selection>."
    return "\n".join([*parts, end])


def embed(texts: DataFrame, column: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """(text, embedding) of the distinct texts, encoded in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[list[float]] = []
            for start in range(0, len(frame), batch):
                found += encode(frame["text"].iloc[start : start + batch].tolist())
            yield pd.DataFrame({"text": frame["text"], "embedding": found})

    distinct = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    return distinct.mapInPandas(run, "text string, embedding array<double>")


def hashed_ngrams(texts: list[str], dim: int = 64, n: int = 3) -> list[list[float]]:
    """An offline encoder: normed counts of character n-grams, hashed into ``dim`` slots."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dim
        for k in range(max(1, len(text) - n + 1)):
            v[zlib.crc32(text[k : k + n].lower().encode()) % dim] += 1.0
        size = sum(x * x for x in v) ** 0.5
        out.append([x / size if size else 0.0 for x in v])
    return out
