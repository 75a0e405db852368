"""Queries of readers, sinks, registries, the metric driver, sample features and model adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.functions import text as t
from tessera.operators import clusters, evaluation, features, metric_dedup, models, scoring
from tessera.plans.q_agents import _folder
from tessera.plans.q_eval import BLEU, CLASSES, r6
from tessera.plans.q_text import SCORED
from tessera.plans.registry import query
from tessera.sources import readers, registry, writers


def _document(rows, path: str) -> None:
    """One row of one column as a JSON document."""
    writers.text(rows.select(F.to_json(F.col(rows.columns[0])).alias("value")).coalesce(1), "value", path)


@query("SELECT doc_id, quality, toxic FROM labels")
def json_list(i):
    _document(i.table("labels").agg(F.collect_list(F.struct("*")).alias("x")), p := _folder(i))
    return readers.load(i.spark, p, "doc_id long, quality int, toxic int", fmt="json")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'alone'")
def json_data(i):
    base, schema = _folder(i), "n_nationkey int, n_name string"
    nation = i.table("nation").agg(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("data")).alias("x"))
    region = i.table("region").agg(F.collect_list(F.struct(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))).alias("x"))
    alone = i.spark.range(1).select(F.struct(F.lit(99).alias("n_nationkey"), F.lit("alone").alias("n_name")).alias("x"))
    for name, rows in (("a", nation), ("b", region), ("c", alone)):
        _document(rows, f"{base}/{name}")
    a_, b, c = (readers.json_data(i.spark, f"{base}/{name}", schema) for name in "abc")
    return a_.unionByName(b).unionByName(c).unionByName(readers.json_data(i.spark, f"{base}/none", schema))


@query("SELECT count(*) FILTER (c_custkey % 5 > 0) AS n FROM customer")
def line_count(i):
    writers.text(i.table("customer").select(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name")).alias("value")), "value", p := _folder(i))
    return readers.line_count(i.spark, p)


@query("SELECT n_nationkey AS id, n_name AS name, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT n_nationkey + 100, 'again', NULL FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region")
def load_folder(i):
    base = _folder(i)
    nation = i.table("nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    writers.jsonl(nation, f"{base}/a.jsonl")
    writers.jsonl(nation.select((F.col("id") + 100).alias("id"), F.lit("again").alias("name")), f"{base}/b.jsonl")
    i.table("region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name"), F.lit("r").alias("extra")).write.parquet(f"{base}/c.parquet")
    i.spark.range(1).write.parquet(f"{base}/_hidden.parquet")
    return readers.load_folder(i.spark, base, "id int, name string")[0]


@query("SELECT n_regionkey AS cluster_id, n_nationkey AS sample_id, 'Q' || n_name AS question, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation")
def cluster_file(i):
    dialogue = F.array(F.struct(F.concat(F.lit("Q"), "n_name").alias("question"), F.lit("a").alias("answer")))
    rows = i.table("nation").select(F.col("n_regionkey").cast("long").alias("cluster_id"), F.col("n_nationkey").cast("long").alias("sample_id"), dialogue.alias("dialogue"), F.lit("vqa").alias("task_type"))
    writers.cluster_file(rows, lines := _folder(i), ["dialogue", "task_type"], most=2)
    back = i.spark.read.schema("cluster_id long, part int, size long, samples array<struct<sample_id:bigint,cluster_id:bigint,data:struct<dialogue:array<struct<question:string,answer:string>>,task_type:string>>>").json(lines)
    # The parts of all clusters, as the one document that the cluster reader takes.
    _document(back.agg(F.struct(F.collect_list(F.struct("cluster_id", "size", "samples")).alias("clusters")).alias("x")), p := _folder(i))
    return readers.clusters(i.spark, p).select("cluster_id", "sample_id", F.col("data.dialogue")[0]["question"].alias("question"), "size")


@query("SELECT n_regionkey AS cluster_id, n_nationkey AS sample_id FROM nation WHERE n_regionkey < 2")
def cluster_sample_files(i):
    base = _folder(i)
    for k in range(2):
        own = i.table("nation").where(F.col("n_regionkey") == k)
        sample = F.struct(F.col("n_nationkey").cast("string").alias("sample_id"), F.struct(F.col("n_regionkey").cast("long").alias("cluster_id")).alias("metadata"))
        _document(own.agg(F.struct(F.lit(k).alias("cluster_id"), F.collect_list(sample).alias("samples")).alias("x")), f"{base}/cluster_{k}")
    found = readers.cluster_samples(i.spark, f"{base}/*/part-*")
    return found.select(F.col("metadata.cluster_id").alias("cluster_id"), F.col("sample_id").cast("int").alias("sample_id"))


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, cap, corr, corr_conf, train, CAST(n_metrics AS INTEGER) AS n_metrics FROM ({v_scores}) s")
def evaluation_triples(i):
    metrics = F.transform(F.sequence(F.lit(1), F.col("n_metrics")), lambda k: F.struct(k.cast("string").alias("general_metric_description"), F.lit("").alias("specific_metric_description")))
    entry = F.struct(F.col("corr").alias("correctness_score"), F.col("corr_conf").alias("correctness_confidence"), F.col("train").alias("training_quality_score"), F.col("train_conf").alias("training_quality_confidence"), metrics.alias("recommended_metrics"))
    wide = i.view("v_scores").groupBy(F.col("sample_id").cast("string").alias("sample_id")).agg(*[F.max(F.when(F.col("cap") == g, entry)).alias(g) for g in scoring.GRADERS])
    wide.write.json(p := _folder(i))
    return readers.grader_rows(readers.evaluation_triples(i.spark, p, lines=True)).select("sample_id", "cap", "corr", "corr_conf", "train", "n_metrics")


@query("SELECT 'agent ' || n_name AS name, n_nationkey % 3 AS models FROM nation")
def agent_plan_file(i):
    agent = F.struct(F.concat(F.lit("agent "), "n_name").alias("name"), F.array(F.lit("s")).alias("specialty"), F.slice(F.array(F.lit("m1"), F.lit("m2")), 1, (F.col("n_nationkey") % 3).cast("int")).alias("suggested_models"), F.lit("p").alias("prompt"))
    _document(i.table("nation").agg(F.struct(F.collect_list(agent).alias("agents")).alias("x")), p := _folder(i))
    return readers.agent_plan(i.spark, p).select(F.inline("agents")).select("name", F.size("suggested_models").alias("models"))


@query("SELECT 'report ' || n_name AS report, n_nationkey % 2 + 1 AS agents, n_nationkey % 3 + 1 AS data FROM nation")
def selection_input_file(i):
    data = F.struct(F.sequence(F.lit(0), F.col("n_nationkey") % 3).cast("array<bigint>").alias("data_ids"), F.struct(F.lit("r").alias("filter_reason"), F.lit(1).alias("sample_count")).alias("metadata"))
    rows = i.table("nation").select(F.struct(F.concat(F.lit("report "), "n_name").alias("report"), F.slice(F.array(F.lit("x"), F.lit("y")), 1, (F.col("n_nationkey") % 2 + 1).cast("int")).alias("agent_list"), F.array(data).alias("filtered_datasets")).alias("x"))
    writers.jsonl(rows.select("x.*"), p := f"{_folder(i)}/input.jsonl")
    return readers.selection_input(i.spark, p).select("report", F.size("agent_list").alias("agents"), F.size(F.col("filtered_datasets")[0]["data_ids"]).alias("data"))


@query("SELECT name, max(n) AS n FROM (SELECT 'b' || (n_nationkey % 7) AS name, n_nationkey AS n FROM nation) t GROUP BY name")
def benchmark_catalog_file(i):
    entry = F.struct(F.concat(F.lit("b"), (F.col("n_nationkey") % 7).cast("string")).alias("name"), F.col("n_nationkey").cast("string").alias("source"))
    listed = i.table("nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"]).alias("b"))
    _document(listed.select(F.struct(F.col("b").alias("benchmarks")).alias("x")), p := _folder(i))
    return readers.benchmark_catalog(i.spark, p).select("name", F.col("source").cast("int").alias("n"))


SCORED_TASKS = "s AS (SELECT benchmark, CASE WHEN lower(trim(answer)) = lower(trim(ground_truth)) THEN 1.0::DOUBLE WHEN contains(lower(trim(answer)), lower(trim(ground_truth))) OR contains(lower(trim(ground_truth)), lower(trim(answer))) THEN 0.5 ELSE 0 END AS score FROM ({v_tasks}) t)"


@query(f"WITH {SCORED_TASKS} SELECT benchmark, count(*) AS total, round(avg((score = 1)::INT), 6) AS accuracy, avg((score = 1)::INT) < 0.7 AS is_poor_performer FROM s GROUP BY benchmark")
def bench_report_sink(i):
    summary = evaluation.benchmark_summary(evaluation.scored_answers(i.view("v_tasks")))
    writers.benchmark_report(summary, p := _folder(i))
    back = i.spark.read.schema("benchmark string, total long, accuracy double, is_poor_performer boolean").json(p)
    return r6(back, "accuracy")


@query("SELECT 'v20260101_00' || (r_regionkey + 1) AS version, 'nations: ' || n AS description FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) t ON r_regionkey = n_regionkey WHERE r_regionkey <> 1")
def version_registry(i):
    """A version for each region, described by its number of nations; the second is deleted."""
    base = _folder(i)
    i.table("region").write.parquet(f"{base}/model")
    counts = i.table("nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).orderBy("n_regionkey").collect()
    names = [registry.register_version(i.spark, f"{base}/registry", f"{base}/model", "20260101", description=f"nations: {r.n}") for r in counts]
    registry.delete_version(i.spark, f"{base}/registry", names[1])
    return registry.versions(i.spark, f"{base}/registry").select("version", "description")


@query("SELECT epoch, loss FROM (SELECT epoch, avg(val_loss) AS loss FROM ({v_history}) t WHERE epoch <= 4 GROUP BY epoch) t ORDER BY loss, epoch LIMIT 2")
def checkpoint_store(i):
    """The first four epochs' mean losses over all runs; the two best checkpoints stay."""
    base = _folder(i)
    i.table("region").write.parquet(f"{base}/weights")
    means = i.view("v_history").where("epoch <= 4").groupBy("epoch").agg(F.avg("val_loss").alias("loss")).orderBy("epoch").collect()
    for r in means:
        registry.save_checkpoint(i.spark, f"{base}/store", f"{base}/weights", r.epoch, r.loss, keep=2)
    return registry.checkpoints(i.spark, f"{base}/store").select(F.col("epoch").cast("long").alias("epoch"), "loss")


@query("SELECT round(avg((pred = label)::INT), 6) AS accuracy, round(avg((pred = label)::INT), 6) AS exact_match, " + f"(WITH {CLASSES} SELECT round(avg(f1), 6) FROM f) AS f1, (WITH {CLASSES} SELECT round(sum(f1 * support) / sum(support), 6) FROM f) AS f1_weighted, round(avg((pred = label)::INT), 6) AS f1_micro FROM ({{v_class}}) t")
def metric_driver(i):
    names = ["accuracy", "exact_match", "f1", "f1_weighted", "f1_micro"]
    return r6(evaluation.compute(i.view("v_class"), [*names, "no_such_metric"]), *names)


@query(BLEU + ", y AS (SELECT pred, label, (pred = label)::INT AS hit FROM ({v_pairs}) t) SELECT (SELECT round(avg(bleu), 6) FROM b) AS bleu, (SELECT round(avg(hit), 6) FROM y) AS accuracy")
def metric_driver_texts(i):
    return r6(evaluation.compute(i.view("v_pairs"), ["bleu", "accuracy"]), "bleu", "accuracy")


@query("SELECT c_custkey AS n, c_name AS pred, c_mktsegment AS label FROM customer")
def positional_join(i):
    side = lambda c, name: i.table("customer").select(F.col("c_custkey").alias("n"), F.col(c).alias(name))
    return evaluation.positional_join(side("c_name", "pred"), side("c_mktsegment", "label"), "n")


QW = "len(list_filter(string_split(trim(regexp_replace(question, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"WITH d AS (SELECT conv_id, count(*) AS turns, round(avg({QW}), 6) AS q_words_mean FROM ({{v_turns}}) t GROUP BY conv_id), s AS (SELECT DISTINCT conv_id FROM conversations) SELECT s.conv_id, coalesce(turns, 0) AS turns, coalesce(q_words_mean, 0) AS q_words_mean, s.conv_id % 3 AS n_images, (s.conv_id % 2 = 0)::INT AS is_vqa, 0 AS is_caption, (s.conv_id % 2 = 1)::INT AS is_turn FROM s LEFT JOIN d USING (conv_id)")
def sample_statistics(i):
    images = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("conv_id") % 3).cast("int"))
    samples = i.table("conversations").select("conv_id").distinct().select("conv_id", images.alias("images"), F.when(F.col("conv_id") % 2 == 0, "VQA").otherwise("multi-turn").alias("task_type"))
    found = features.statistical_features(i.view("v_turns"), samples)
    return r6(found.select("conv_id", "turns", "q_words_mean", F.col("n_images").cast("long").alias("n_images"), "is_vqa", "is_caption", "is_turn"), "q_words_mean")


@query("WITH v AS (SELECT a.vec_id AS conv_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), t AS (SELECT conv_id FROM ({v_turns}) t GROUP BY conv_id) SELECT t.conv_id, round(CASE WHEN t.conv_id % 4 = 0 THEN 0 ELSE coalesce(list_cosine_similarity(x, y), 0) END, 6) AS image_question, CASE WHEN t.conv_id % 4 = 0 OR x IS NULL THEN 0::DOUBLE ELSE 1 END AS question_answer FROM t LEFT JOIN v USING (conv_id)")
def sample_interaction(i):
    e = i.table("embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    vectors = pairs.select(F.col("a.vec_id").alias("conv_id"), F.when(F.col("a.vec_id") % 4 != 0, F.col("a.embedding")).alias("image"), F.col("b.embedding").alias("question"), F.col("b.embedding").alias("answer"))
    found = features.vector_interaction(i.view("v_turns"), vectors)
    return r6(found.select("conv_id", "image_question", "question_answer"), "image_question", "question_answer")


@query(
    f"""WITH {SCORED}, flagged AS (SELECT *, round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3 AS hard FROM scored),
    pooled AS (SELECT m.sample_id, general, specific FROM ({{v_metrics}}) m JOIN flagged f USING (sample_id) WHERE NOT hard AND CASE m.cap WHEN 'weak' THEN abs(weak_combined - sota_combined) < 2.5 WHEN 'normal' THEN abs(normal_combined - sota_combined) < 2.5 ELSE true END),
    merged AS (SELECT general, count(DISTINCT nullif(specific, '')) AS n FROM pooled GROUP BY general)
    SELECT (SELECT count(*) FROM pooled) AS original_metrics, (SELECT count(*) FROM merged) AS merged_metrics, (SELECT count(*) FROM pooled) AS original_specifics, CAST((SELECT coalesce(sum(n), 0) FROM merged) AS BIGINT) AS merged_specifics,
           CASE WHEN (SELECT count(*) FROM pooled) = 0 THEN 0 ELSE round(1 - (SELECT count(*) FROM merged) / (SELECT count(*) FROM pooled), 6) END AS deduplication_rate, CASE WHEN (SELECT count(*) FROM pooled) = 0 THEN 0 ELSE round((SELECT count(*) FROM merged) / (SELECT count(*) FROM pooled), 6) END AS reduction_ratio,
           CASE WHEN (SELECT count(*) FROM pooled) = 0 THEN 0 ELSE round(1 - coalesce((SELECT sum(n) FROM merged), 0) / (SELECT count(*) FROM pooled), 6) END AS specific_reduction_rate, (SELECT count(*) FROM flagged WHERE hard) AS hard_cases"""
)
def batch_deduplication(i):
    scored = scoring.score(scoring.align(i.view("v_scores")))
    pooled = scoring.pooled_metrics(scored, i.view("v_metrics"))
    # Merged by equal general description, so that SQL can say it too.
    merged = pooled.groupBy("general").agg(F.collect_set(F.nullif("specific", F.lit(""))).alias("specifics"))
    return r6(scoring.deduplication_statistics(pooled, merged, scored), "deduplication_rate", "reduction_ratio", "specific_reduction_rate")


@query("SELECT a.vec_id AS a, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_similarity(i):
    e = i.table("embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return pairs.select(F.col("a.vec_id").alias("a"), F.round(metric_dedup.similarity(F.lit("x"), F.lit("y"), frozenset(), F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity"))


@query("SELECT vec_id, len(embedding) + 512 + 11 AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def feature_groups(i):
    chosen = features.select_groups(i.table("embeddings"), "vec_id", ["statistical", "image", "answer"], {"image": "embedding"})
    return chosen.select("vec_id", F.size("features").alias("width"), F.round(a.total(F.col("features")), 5).alias("total"))


@query("SELECT item_id, text AS answer FROM benchmark WHERE length(text) <= 200 UNION ALL SELECT item_id, right(text, 200) FROM benchmark WHERE length(text) > 200")
def model_generate(i):
    tasks = i.table("benchmark").select("item_id", F.col("text").alias("question"))
    return models.generate(tasks, models.EchoAdapter).select("item_id", "answer")


@query("SELECT 'b' AS benchmark, count(*) AS total, count(*) FILTER (item_id % 3 = 0) AS correct FROM benchmark WHERE length(text) <= 200")
def benchmark_manager(i):
    manager = models.BenchmarkManager()
    items = lambda spark: i.table("benchmark").where("length(text) <= 200").select("item_id", F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).when(F.col("item_id") % 3 == 1, F.lit("another answer")).otherwise(F.concat("text", F.lit(" and more"))).alias("answer"))
    manager.register(models.Benchmark("b", items, "item_id"))
    return evaluation.benchmark_summary(manager.evaluate(i.spark, ["b"], models.EchoAdapter)).select("benchmark", "total", "correct")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'data:image/png;base64,AA==' WHEN 1 THEN 'data:image/jpeg;base64,' || repeat('QUJD', 6) END AS image FROM nation")
def pick_image(i):
    k = F.col("n_nationkey") % 3
    images = (F.when(k == 0, "data:image/png;base64,AA=="), F.when(k == 1, "").otherwise("no image"), F.when(k == 1, F.repeat(F.lit("QUJD"), 6)))
    return i.table("nation").select(F.col("n_nationkey").alias("id"), t.pick_image(*images).alias("image"))


@query("SELECT n_nationkey AS id, n_nationkey % 3 AS n FROM nation")
def usable_images(i):
    good = F.base64(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.lit("0123456789").cast("binary")))
    images = F.concat(F.array_repeat(good, (F.col("n_nationkey") % 3).cast("int")), F.array(F.lit("????"), F.base64(F.lit("just some words").cast("binary"))))
    return i.table("nation").select(F.col("n_nationkey").alias("id"), F.size(t.usable_images(images)).alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'b' WHEN contains(lower(c_mktsegment), 'e') THEN 'e' ELSE 'other' END AS kind FROM customer")
def detect_kind(i):
    return i.table("customer").select(F.col("c_custkey").alias("id"), t.detect(F.col("c_mktsegment"), {"build": "b", "e": "e"}, "other").alias("kind"))


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, cap, corr, CAST(n_metrics AS INTEGER) AS n_metrics FROM ({v_scores}) s WHERE sample_id % 5 > 0")
def evaluation_records(i):
    metrics = F.transform(F.sequence(F.lit(1), F.col("n_metrics")), lambda k: F.struct(k.cast("string").alias("general_metric_description"), F.lit(None).cast("string").alias("specific_metric_description")))
    texts = [F.when(F.col("sample_id") % 5 > 0, "x").alias(f) for f in ("correctness_rationale", "training_quality_rationale", "overall_assessment")]
    reply = F.struct(F.col("corr").alias("correctness_score"), F.col("corr_conf").alias("correctness_confidence"), F.col("train").alias("training_quality_score"), F.col("train_conf").alias("training_quality_confidence"), *texts, metrics.alias("recommended_metrics"), F.lit(None).cast("string").alias("information_recap"))
    replies = i.view("v_scores").select(F.col("sample_id").cast("string").alias("sample_id"), F.lit("m").alias("model_name"), F.col("cap").alias("model_capability"), reply.alias("reply"), F.lit("2026").alias("timestamp"))
    writers.evaluation_triples(scoring.evaluations(replies, strict=False), p := _folder(i))
    return readers.grader_rows(readers.evaluation_triples(i.spark, p, lines=True)).select("sample_id", "cap", "corr", "n_metrics")


@query(f"WITH {SCORED} SELECT 'hard_cases' AS part, count(*) AS n FROM scored WHERE round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3 UNION ALL SELECT 'prompt', 2")
def batch_report_sink(i):
    scored = scoring.score(scoring.align(i.view("v_scores")))
    prompt = i.spark.range(2).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    writers.batch_report(scoring.hard_cases(scored).select("sample_id", "difficulty"), i.view("v_metrics").select("general"), scored.agg(F.count("*").alias("n")), prompt, p := _folder(i))
    count = lambda rows, name: rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(i.spark.read.schema("sample_id long").json(f"{p}/hard_cases"), "hard_cases").unionByName(count(i.spark.read.text(f"{p}/prompt"), "prompt"))


@query("SELECT id, agents FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE 2 END AS agents FROM ({v_completions}) t) x")
def selection_inference(i):
    class Replies:
        """The prompt is the reply of a model that was asked before."""

        def load(self):
            pass

        def generate(self, prompts):
            return prompts

    answered = models.generate(i.view("v_completions").select("id", "text"), Replies, prompt="text")
    return answered.select("id", F.size(t.selection_agents(F.col("answer"))).alias("agents"))


@query()
def hierarchical_auto_k(i):
    return clusters.hierarchical(i.table("embeddings"), "vec_id", 3, 8, most=300)[0]


@query()
def mini_batch_kmeans(i):
    return clusters.mini_batch_kmeans(i.table("embeddings"), 8, "vec_id", rounds=30)[0]
