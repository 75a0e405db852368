"""Queries of the choice of agents: prompts and inference modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import samples, scoring, selection
from tessera.plans.q_text import SCORED
from tessera.plans.registry import query


class _Chooser:
    """Chooses by the length of the user's words, and by whether it was told of agents."""

    def load(self) -> None:
        return None

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            told, report = p.startswith("[system]"), p.rsplit("[user]\n", 1)[-1]
            names = ["reader", "counter"][: 1 + len(report) % 2] if told else ["critic"]
            blocks = "".join(f"<agent><name>{n}</name><prompt>{len(report)}</prompt></agent>" for n in names)
            out.append(f"<selection><reasoning>{'told' if told else 'alone'}</reasoning><agents>{blocks}</agents></selection>")
        return out


@query(
    """WITH n AS (SELECT c_custkey AS id, length(c_name) + length('REPORT IS :' || chr(10) || ' ') AS told, length(c_name) AS alone FROM customer)
    SELECT id, 'system_prompt' AS prompt_mode, 'told' AS reasoning, 1 + told % 2 AS agents, CAST(told AS VARCHAR) AS first_prompt FROM n
    UNION ALL SELECT id, 'direct', 'alone', 1, CAST(alone AS VARCHAR) FROM n"""
)
def selection_modes(i):
    """Customers' names as reports, under a system prompt and without one."""
    reports, known = i.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("report")), [("reader", "reads"), ("counter", "counts")]
    both = [selection.predict(reports, _Chooser, mode, known) for mode in selection.MODES]
    first = F.element_at("prompts", F.col("agents")[0])
    return both[0].unionByName(both[1]).select("id", "prompt_mode", "reasoning", F.size("agents").cast("long").alias("agents"), first.alias("first_prompt"))


@query(
    f"""WITH {SCORED}, hard AS (SELECT sample_id, printf('- sample %s: difficulty %.2f, confidence %.2f', CAST(sample_id AS VARCHAR), difficulty, confidence) AS line FROM scored
     WHERE round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3 ORDER BY sample_id LIMIT 3),
    m AS (SELECT sample_id AS grp, k, '- ' || general || ': ' || specific AS line FROM ({{v_metrics}}) t),
    g AS (SELECT grp, string_agg(line, chr(10) ORDER BY k) AS metrics FROM m GROUP BY grp)
    SELECT grp, md5('Quality metrics:' || chr(10) || metrics || chr(10) || chr(10) || 'Hard cases:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY sample_id) FROM hard) || chr(10) || chr(10)
     || 'Agents:' || chr(10) || (SELECT string_agg('- ' || agent || ': ' || prompt, chr(10) ORDER BY '- ' || agent || ': ' || prompt) FROM ({{v_agents}}) a) || chr(10) || chr(10) || 'Name the agents to use.') AS digest FROM g"""
)
def decision_prompts(i):
    """A prompt for each sample's metrics, with the first hard cases and all agents."""
    metrics = samples.metric_lines(i.view("v_metrics").select(F.col("sample_id").alias("grp"), F.col("k").alias("position"), "general", F.array("specific").alias("specifics")))
    cases = samples.hard_case_lines(scoring.hard_cases(scoring.score(scoring.align(i.view("v_scores")))))
    agents = i.view("v_agents").select(F.concat(F.lit("- "), "agent", F.lit(": "), "prompt").alias("line"))
    return selection.decision_prompts(metrics, cases, agents, simple=True).select("grp", F.md5("prompt").alias("digest"))
