"""Agents: plans, tasks of samples and agents, and running tasks against a model client."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t

#: The most agents that are broadcast to all tasks; a plan is a small table by nature.
MOST_AGENTS = 10_000


def plan_agents(plan: DataFrame) -> DataFrame:
    """(agent, prompt) from a plan file's rows; an agent without a prompt is an error."""
    agents = plan.select(F.inline("agents"))
    prompt = t.first_filled(*[F.col(c) for c in ("prompt", "prompt_scaffold") if c in agents.columns])
    return agents.select(F.col("name").alias("agent"), F.when(prompt.isNull(), F.raise_error(F.concat(F.lit("agent without a prompt: "), F.coalesce("name", F.lit("?"))))).otherwise(prompt).alias("prompt"))


def catalog_lines(catalog: DataFrame) -> DataFrame:
    """One line of text for each agent: its specialties and first three suggested models."""
    models = F.array_join(F.slice("suggested_models", 1, 3), ", ")
    return catalog.select(F.inline("agents")).select("name", F.concat(F.col("name"), F.lit(": specialty=["), F.array_join("specialty", ", "), F.lit("], suggested_models=["), F.coalesce(t.not_empty(models), F.lit("N/A")), F.lit("]")).alias("line"))


def task_prompt(prompt: Column, sample: Column, most: int = 2000) -> Column:
    return F.concat(prompt, F.lit("\n\nContext:\n"), t.truncate_middle(F.to_json(sample), most), F.lit("\n\nAnswer for this sample."))


def build_tasks(samples: DataFrame, agents: DataFrame, key: str, context: list[str]) -> DataFrame:
    """(sample_id, agent, prompt): every sample with every agent of the plan."""
    if agents.limit(MOST_AGENTS + 1).count() > MOST_AGENTS:
        raise ValueError(f"a plan has at most {MOST_AGENTS} agents")
    listed = agents.agg(F.collect_list(F.struct("agent", "prompt")).alias("agents"))
    held = [r.asDict() for r in listed.select(F.inline("agents")).orderBy("agent").collect()]
    plan = F.array(*[F.struct(F.lit(r["agent"]).alias("agent"), F.lit(r["prompt"]).alias("p")) for r in held]) if held else F.array().cast("array<struct<agent:string,p:string>>")
    spread = samples.select(F.col(key).cast("string").alias("sample_id"), F.struct(*context).alias("context"), F.explode(plan).alias("a"))
    return spread.select("sample_id", F.col("a.agent").alias("agent"), task_prompt(F.col("a.p"), F.col("context")).alias("prompt"))


def known_tasks(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Tasks whose agent is known."""
    return tasks.join(agents.select("agent").distinct(), "agent", "left_semi")


class FatalError(Exception):
    """A reply that trying again can't mend."""


def dummy_client(agent: str, prompt: str) -> dict:
    """Stands in for a model: a fixed reply that depends on its input alone."""
    return {"text": f"{agent}: {len(prompt)} characters", "raw": "", "usage": "0"}


def with_retries(call: Callable[[str, str], dict], retries: int = 2, pause: float = 1.5) -> Callable[[str, str], dict]:
    """Tries again after growing pauses; a fatal error isn't tried again."""

    def run(agent: str, prompt: str) -> dict:
        for turn in range(retries + 1):
            try:
                return call(agent, prompt)
            except FatalError:
                raise
            except Exception:
                if turn == retries:
                    raise
                time.sleep(pause * (turn + 1))
        raise AssertionError

    return run


def run_tasks(tasks: DataFrame, client: Callable[[str, str], dict] = dummy_client, retries: int = 2, pause: float = 1.5) -> DataFrame:
    """(sample_id, agent, text, raw, usage, error): a failing task gives a row with its error, and no other task fails."""
    call = with_retries(client, retries, pause)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sample, agent, prompt in frame[["sample_id", "agent", "prompt"]].itertuples(index=False):
                try:
                    reply = call(agent, prompt)
                    out.append((sample, agent, reply.get("text"), reply.get("raw"), str(reply.get("usage")), None))
                except Exception as e:  # one row's failure is that row's result
                    out.append((sample, agent, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["sample_id", "agent", "text", "raw", "usage", "error"])

    return tasks.select("sample_id", "agent", "prompt").mapInPandas(run, "sample_id string, agent string, text string, raw string, usage string, error string")


def flatten_selection(rows: DataFrame) -> DataFrame:
    """One row for each filtered dataset of a report, with the report's agents."""
    return rows.select("report", F.col("agent_list").alias("ground_truth_agents"), F.posexplode("filtered_datasets").alias("position", "d")).select("report", "ground_truth_agents", "position", F.col("d.data_ids").alias("ground_truth_filtered_data"))


def conversation(system: str, report: Column) -> Column:
    entry = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(entry("system", F.lit(system)), entry("user", F.concat(F.lit("REPORT IS :\n "), report)))


def system_prompt(agents: list[tuple[str, str]]) -> str:
    lines = "\n".join(f"- {name}: {about}" for name, about in agents)
    return f"Choose agents for the report from this list and say why.\n{lines}\nReply as <selection><reasoning>...</reasoning><agents><agent><name>...</name><prompt>...</prompt></agent></agents></selection>."


def registry(config: dict, factories: dict[str, Callable[[dict], Callable]]) -> dict[str, Callable]:
    """Agent clients by name from a config; an unknown type is an error."""
    out = {}
    for name, entry in config.items():
        kind = entry.get("type")
        if kind not in factories:
            raise ValueError(f"unknown agent type {kind!r} of {name!r}")
        out[name] = factories[kind](json.loads(json.dumps(entry)))
    return out
