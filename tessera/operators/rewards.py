"""Rewards of selection replies and their group-relative advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.functions import text as t


def agent_reward(reply: Column, truth: Column) -> Column:
    """F1 of the agents that the reply selects against the true ones."""
    return a.set_f1(F.array_distinct(t.selection_agents(reply)), F.array_distinct(truth))


def filtering_reward(selected: Column, truth: Column) -> Column:
    """F1 of selected data ids; ``selected`` is what an executor of the selected agents returns."""
    return a.set_f1(F.array_distinct(selected), F.array_distinct(truth))


def combined_reward(agents: Column, filtering: Column, agent_weight: float = 0.5, filter_weight: float = 0.5) -> Column:
    return agent_weight * agents + filter_weight * filtering


#: Name to column builder over (reply, true agents, selected ids, true ids).
REWARDS = {
    "agent_selection": lambda reply, agents, ids, true_ids: agent_reward(reply, agents),
    "filtering_quality": lambda reply, agents, ids, true_ids: filtering_reward(ids, true_ids),
    "format": lambda reply, agents, ids, true_ids: t.selection_well_formed(reply),
    "combined": lambda reply, agents, ids, true_ids: combined_reward(agent_reward(reply, agents), filtering_reward(ids, true_ids)),
}


def total_reward(names: list[str], *columns: Column) -> Column:
    found = [REWARDS[n](*columns) for n in names]
    return sum(found[1:], found[0])


def group_advantage(df: DataFrame, prompt: str, reward: str, eps: float = 1e-4) -> DataFrame:
    """Adds ``advantage``: the reward less its prompt's mean, over the sample deviation.

    Mean and deviation come from one aggregate joined back, so a hot prompt is
    combined on the map side; a prompt with a single reward has deviation 0.
    """
    stats = df.groupBy(F.col(prompt).alias("_p")).agg(F.avg(reward).alias("_m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"))
    joined = df.join(stats, F.col(prompt).eqNullSafe(F.col("_p")))
    return joined.withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + eps)).drop("_p", "_m", "_s")


def reward_means(df: DataFrame, kind: str, reward: str) -> DataFrame:
    return df.groupBy(kind).agg(F.avg(reward).alias("mean"), F.count("*").alias("n"))


def masked_loss(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: the mean over sequences of each one's mean where the mask is 1."""
    return df.agg(F.coalesce(F.avg(a.masked_mean(F.col(values), F.col(mask))), F.lit(0.0)).alias("loss"))


def prompt_window(prompt: str):
    return Window.partitionBy(prompt)
