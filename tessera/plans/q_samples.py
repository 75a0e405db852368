"""Queries of nested samples, prompts and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.operators import features, samples, scoring
from tessera.plans.q_agents import ALL, _folder, _tokens
from tessera.plans.q_text import SCORED
from tessera.plans.registry import query
from tessera.sources import writers

DIALOGUE = "SELECT conv_id, list_transform(list_sort(list({'i': idx, 'q': question, 'a': answer})), lambda x: x) AS d FROM ({v_turns}) t GROUP BY conv_id"


def _dialogues(i):
    v = i.view("v_turns").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "question", "answer"))).alias("d"))
    return v.select("conv_id", F.transform("d", lambda x: F.struct(x["question"].alias("question"), F.when(x["idx"] % 3 < 2, x["answer"]).otherwise("").alias("answer"))).alias("dialogue"))


@query("SELECT CAST(conv_id AS VARCHAR) AS sample_id, count(*) FILTER (idx % 3 < 2 AND question <> '' AND answer <> '') AS turns, CASE WHEN conv_id % 2 = 0 THEN 'aGk=' ELSE 'QUJD' END AS image FROM ({v_turns}) t GROUP BY conv_id")
def cluster_to_samples(i):
    buffers = F.array(F.struct(F.when(F.col("conv_id") % 2 == 0, "b'hi'").otherwise("QUJD").alias("buffer"), F.lit("x").alias("image_id")), F.struct(F.lit("").alias("buffer"), F.lit("y").alias("image_id")))
    data = F.struct("dialogue", buffers.alias("image_buffer_list"), F.array(F.lit("x")).alias("image_id_list"), F.lit("vqa").alias("task_type"), F.lit("s").alias("source"))
    rows = _dialogues(i).select(F.lit(0).cast("long").alias("cluster_id"), F.col("conv_id").alias("sample_id"), data.alias("data"))
    out = samples.data_samples(rows)
    return out.select("sample_id", F.coalesce(F.size("dialogue"), F.lit(0)).cast("long").alias("turns"), F.element_at("image_base64", 1).alias("image"))


@query("SELECT conv_id, 'You grade as a sota model.' || chr(10) || array_to_string(list_transform(d, lambda x: (x.i + 1) || '. Q: ' || x.q || chr(10) || '   A: ' || CASE WHEN x.i % 3 < 2 THEN x.a ELSE '' END), chr(10)) || chr(10) || 'Reply with one JSON object: correctness_score, training_quality_score (0 to 10).' AS prompt FROM (" + DIALOGUE + ") t")
def grading_prompt(i):
    return _dialogues(i).select("conv_id", samples.grading_prompt(F.col("dialogue"), F.lit("sota"), simple=True).alias("prompt"))


@query(f"WITH {SCORED}, h AS (SELECT sample_id, difficulty, confidence FROM scored WHERE round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3 ORDER BY sample_id LIMIT 3) SELECT sample_id, printf('- sample %s: difficulty %.2f, confidence %.2f', CAST(sample_id AS VARCHAR), difficulty, confidence) AS line FROM h")
def hard_case_lines(i):
    return samples.hard_case_lines(scoring.hard_cases(scoring.score(scoring.align(i.view("v_scores")))))


@query("SELECT CAST(sample_id AS VARCHAR) AS grp, k AS position, '- ' || general || ': ' || specific AS line FROM ({v_metrics}) t WHERE k < 2")
def metric_lines(i):
    m = i.view("v_metrics").select(F.col("sample_id").cast("string").alias("grp"), F.col("k").alias("position"), "general", F.array("specific", "cap").alias("specifics"))
    return samples.metric_lines(m, most=2, specifics=1)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name || chr(10) || chr(10) || c_mktsegment ELSE 'plain' END AS text FROM customer")
def causal_text(i):
    return i.table("customer").select(F.col("c_custkey").alias("id"), samples.causal_text(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_mktsegment"), F.lit("plain")).alias("text"))


@query()
def caption_choice(i):
    return i.table("customer").select(F.col("c_custkey").alias("id"), samples.caption_choice(F.array("c_name", "c_mktsegment"), F.col("c_custkey")).alias("caption"))


@query(f"{ALL} SELECT doc_id FROM x WHERE len(list_filter(ids, lambda v: v < 0 OR v >= 120)) > 0")
def token_range_violations(i):
    return _tokens(i).where(F.exists("ids", lambda v: (v < 0) | (v >= 120))).select("doc_id")


@query("SELECT conv_id, idx, conv_id // 100 AS batch FROM ({v_turns}) t")
def batch_ids(i):
    return features.batches(i.view("v_turns"), "conv_id", 100).select("conv_id", "idx", "batch")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN c_custkey < floor(n * 0.8::DOUBLE) THEN 'train' WHEN c_custkey < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM customer, (SELECT count(*) AS n FROM customer) c) t GROUP BY split")
def split_sink(i):
    from tessera.operators.sampling import ordered_split

    rows = ordered_split(i.table("customer").withColumn("ordinal", F.col("c_custkey")), "ordinal")
    writers.by_split(rows, p := _folder(i))
    return i.spark.read.parquet(p).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS cluster_id, count(*) AS n FROM customer GROUP BY c_mktsegment")
def cluster_sink(i):
    writers.by_cluster(i.table("customer").withColumnRenamed("c_mktsegment", "cluster_id"), p := _folder(i))
    return i.spark.read.schema("c_custkey long, cluster_id string").json(p).groupBy("cluster_id").agg(F.count("c_custkey").alias("n"))


@query()
def embed_texts(i):
    return samples.embed(i.view("v_metrics"), "general", samples.hashed_ngrams)


@query("SELECT sample_id, cap, CASE cap WHEN 'weak' THEN abs((corr + train) / 2 - 5) < 2.5 ELSE true END AS near FROM ({v_scores}) s")
def near_sota(i):
    c = (F.col("corr") + F.col("train")) / 2
    return i.view("v_scores").select("sample_id", "cap", F.when(F.col("cap") == "weak", F.abs(c - 5) < 2.5).otherwise(True).alias("near"))


@query("SELECT sample_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (SELECT sample_id, unnest(string_split(lower(trim(regexp_replace(general, '\\s+', ' ', 'g'))), ' ')) AS w FROM ({v_metrics}) t) x WHERE w <> '' GROUP BY sample_id")
def append_new_words(i):
    from tessera.functions import text as t

    words = i.view("v_metrics").groupBy("sample_id").agg(F.flatten(F.collect_list(t.words(F.lower("general")))).alias("w"))
    return words.select("sample_id", F.array_join(F.array_sort(a.append_new(F.col("w"), F.array().cast("array<string>"))), " ").alias("words")).where("words <> ''")
