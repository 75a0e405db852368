"""Choice of agents by a model: prompts, inference in two modes, and what the replies name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators.agents import conversation, system_prompt
from tessera.operators.models import Adapter, generate

MODES = ("system_prompt", "direct")


def messages(report: Column, mode: str, agents: list[tuple[str, str]] = (), system: str | None = None) -> Column:
    """The conversation for a report: under a system prompt, which names the agents, or the report itself as the user's words."""
    if mode not in MODES:
        raise ValueError(f"unknown prompt mode {mode!r}; modes: {', '.join(MODES)}")
    if mode == "direct":
        return F.array(F.struct(F.lit("user").alias("role"), report.alias("content")))
    return conversation(system_prompt(list(agents)) if system is None else system, report)


def rendered(turns: Column) -> Column:
    """A conversation as one text, for adapters that take text."""
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), F.coalesce(m["content"], F.lit("")))), "\n")


def predict(reports: DataFrame, adapter: Callable[[], Adapter], mode: str = "system_prompt", agents: list[tuple[str, str]] = (), system: str | None = None, report: str = "report", batch: int = 32) -> DataFrame:
    """Adds reasoning, agents, prompts, well_formed, raw_output, prompt_mode and error: the choice that the model's reply names.

    A reply that names none, or that failed, gives an empty list.
    """
    asked = reports.withColumn("_prompt", rendered(messages(F.col(report), mode, agents, system)))
    answered = generate(asked, adapter, "_prompt", batch)
    reply = F.coalesce("answer", F.lit(""))
    return answered.select(
        *[F.col(c) for c in reports.columns], t.selection_reasoning(reply).alias("reasoning"), t.selection_agents(reply).alias("agents"), t.selection_prompts(reply).alias("prompts"),
        t.selection_well_formed(reply).alias("well_formed"), F.col("answer").alias("raw_output"), F.lit(mode).alias("prompt_mode"), "error",
    )


def decision_text(metrics: Column, cases: Column, agents: Column, simple: bool = False) -> Column:
    """The request to choose agents, from arrays of lines: metrics, hard cases (a dash where there are none), agents."""
    listed = F.when(F.size(cases) > 0, cases).otherwise(F.array(F.lit("- none")))
    end = "Name the agents to use." if simple else "Reply as <selection><reasoning>...</reasoning><agents><agent><name>...</name><prompt>...</prompt></agent></agents></selection>."
    head = lambda title: F.array(F.lit(title))
    blank = head("")
    return F.array_join(F.concat(head("Quality metrics:"), metrics, blank, head("Hard cases:"), listed, blank, head("Agents:"), agents, blank, head(end)), "\n")


def decision_prompts(metric_lines: DataFrame, case_lines: DataFrame, agent_lines: DataFrame, simple: bool = False) -> DataFrame:
    """(grp, prompt) for each group of metric lines (grp, position, line), with the same few case lines (sample_id, line) and agent lines (line).

    Cases and agents are lists of a prompt's size and stand in every prompt.
    """
    shared = case_lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "line"))), lambda x: x["line"]).alias("cases"))
    named = agent_lines.agg(F.array_sort(F.collect_list("line")).alias("agents"))
    groups = metric_lines.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]).alias("metrics"))
    whole = groups.join(F.broadcast(shared), F.lit(True)).join(F.broadcast(named), F.lit(True))
    return whole.select("grp", decision_text(F.col("metrics"), F.col("cases"), F.col("agents"), simple).alias("prompt"))
