"""Inputs of the operators, derived from the driver's tables by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_turns": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, question, answer
        FROM (SELECT conv_id, turn, role, text AS question,
                     lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
                     lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
              FROM {conversations} WHERE role <> 'system') t
        WHERE role = 'user' AND next_role = 'assistant'""",
    "v_caps": "SELECT 'weak' AS cap, 0 AS k UNION ALL SELECT 'normal' AS cap, 1 AS k UNION ALL SELECT 'sota' AS cap, 2 AS k",
    "v_scores": """
        SELECT d.doc_id AS sample_id, c.cap AS cap,
               CAST((d.doc_id * 37 + c.k * 11 * (d.doc_id % 4)) % 101 AS DOUBLE) / 10e0 AS corr,
               CAST(50 + (d.doc_id * 13 + c.k * 7) % 51 AS DOUBLE) / 100e0 AS corr_conf,
               CAST((d.doc_id * 53 + c.k * 29 * (d.doc_id % 3)) % 101 AS DOUBLE) / 10e0 AS train,
               CAST(50 + (d.doc_id * 17 + c.k * 5) % 51 AS DOUBLE) / 100e0 AS train_conf,
               CAST(1 + (d.doc_id + c.k) % 3 AS BIGINT) AS n_metrics
        FROM {documents} d CROSS JOIN ({v_caps}) c
        WHERE (d.doc_id + c.k) % 17 <> 0""",
    "v_pred": """
        SELECT doc_id, CAST(quality AS BIGINT) AS label,
               CAST(CASE WHEN (doc_id * 7) % 10 < 2 THEN 1 - quality ELSE quality END AS BIGINT) AS pred
        FROM {labels}""",
    "v_class": """
        SELECT d.doc_id AS doc_id, d.text AS text, d.lang AS label,
               CASE WHEN (d.doc_id * 7) % 10 < 7 THEN d.lang WHEN d.doc_id % 3 = 0 THEN 'en' WHEN d.doc_id % 3 = 1 THEN 'de' ELSE 'it' END AS pred
        FROM {documents} d""",
    "v_pairs": """
        SELECT conv_id * 1000 + idx AS doc_id, answer AS label,
               CASE idx % 5 WHEN 0 THEN answer WHEN 1 THEN replace(answer, 'th', 'TH') || '  ' WHEN 2 THEN question || ' ' || answer WHEN 3 THEN question ELSE '' END AS pred
        FROM ({v_turns}) p""",
    "v_opts": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS question,
               CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS hint,
               p_brand AS a, 'size ' || CAST(p_size AS VARCHAR(10)) AS b, CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE 'price ' || p_brand END AS c, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END AS d,
               CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'b, C' WHEN 2 THEN 'A,D' WHEN 3 THEN 'H' WHEN 4 THEN 'cat' ELSE ' BA ' END AS answer
        FROM {part}""",
    "v_tasks": """
        SELECT item_id, text AS question, text AS ground_truth,
               CASE item_id % 4 WHEN 0 THEN '  ' || text WHEN 1 THEN 'It is: ' || text WHEN 2 THEN 'none of these' ELSE '' END AS answer,
               CASE WHEN item_id % 3 = 0 THEN 'alpha' WHEN item_id % 3 = 1 THEN 'beta' ELSE 'gamma' END AS benchmark
        FROM {benchmark}""",
    "v_agents": """
        SELECT 'reader' AS agent, 'Read the sample with care.' AS prompt UNION ALL SELECT 'counter' AS agent, 'Count what is asked for.' AS prompt
        UNION ALL SELECT 'critic' AS agent, 'Name what is wrong.' AS prompt UNION ALL SELECT 'writer' AS agent, 'Write a better answer.' AS prompt""",
    "v_completions": """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 7 = 0 THEN 'no tags at all'
                    ELSE '<selection><reasoning> because ' || c_mktsegment || ' </reasoning><agents><agent><name>agent' || CAST(c_custkey % 4 AS VARCHAR(10)) || '</name><prompt>p' || CAST(c_custkey % 9 AS VARCHAR(10))
                         || '</prompt></agent><agent><name> agent' || CAST(c_custkey % 3 AS VARCHAR(10)) || ' </name><prompt>q' || CAST(c_custkey % 5 AS VARCHAR(10)) || '</prompt></agent></agents></selection>' END AS text,
               CAST(c_custkey % 4 AS BIGINT) AS t1, CAST(c_custkey % 5 AS BIGINT) AS t2
        FROM {customer}""",
    "v_history": """
        SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS epoch, val_loss
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, floor(CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS val_loss FROM {events} GROUP BY user_id, CAST(ts AS DATE)) h""",
    "v_rewards": "SELECT event_id AS id, user_id AS prompt, event_type AS kind, round(value, 3) AS r FROM {events}",
    "v_metrics": """
        SELECT p_partkey - p_partkey % 3 AS sample_id, CASE p_partkey % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'normal' ELSE 'sota' END AS cap, p_partkey % 3 AS k,
               CASE WHEN p_partkey % 27 = 1 THEN '' ELSE 'share of ' || p_name END AS general,
               CASE WHEN p_partkey % 27 = 1 OR p_partkey % 4 = 0 THEN '' ELSE 'count of ' || p_type || ' by ' || p_brand END AS specific
        FROM {part}""",
}


def _expand(sql: str, table) -> str:
    """Put views (in brackets) and tables into ``sql``."""
    while True:
        new = re.sub(r"\{(\w+)\}", lambda m: table(m[1]) if m[1] in TABLES else VIEWS[m[1]], sql)
        if new == sql:
            return sql
        sql = new


def sql_view(sql: str) -> str:
    """DuckDB text: tables by name."""
    return _expand(sql, lambda t: t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_expand(VIEWS[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))
