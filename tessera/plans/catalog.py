"""All registered queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from tessera.plans import q_agents, q_clusters, q_eval, q_io, q_samples, q_selection, q_text  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
