"""Queries of metrics, benchmarks, sampling and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.functions import text as t
from tessera.operators import evaluation as ev
from tessera.operators import features, sampling
from tessera.plans.q_text import c
from tessera.plans.registry import query


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("SELECT round(avg((pred = label)::INT), 6) AS accuracy FROM ({v_class}) t")
def accuracy(i):
    return r6(i.view("v_class").agg(ev.accuracy(F.col("pred"), F.col("label")).alias("accuracy")), "accuracy")


@query(f"SELECT round(avg((lower({c('pred')}) = lower({c('label')}))::INT), 6) AS em, round(avg((pred = label)::INT), 6) AS em_raw FROM ({{v_pairs}}) t")
def exact_match(i):
    p = F.col("pred"), F.col("label")
    return r6(i.view("v_pairs").agg(ev.exact_match(*p).alias("em"), ev.exact_match(*p, normalize=False).alias("em_raw")), "em", "em_raw")


CLASSES = """classes AS (SELECT l.label AS class, count(*) AS support, count(*) FILTER (l.pred = l.label) AS tp, (SELECT count(*) FROM ({v_class}) p WHERE p.pred = l.label) AS predicted FROM ({v_class}) l GROUP BY l.label),
 f AS (SELECT class, support, tp, predicted - tp AS fp, support - tp AS fn, tp / predicted AS precision, tp / support AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1 FROM classes)"""


@query(f"WITH {CLASSES} SELECT class, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def f1_per_class(i):
    return r6(ev.f1_per_class(i.view("v_class")), "precision", "recall", "f1")


@query("SELECT round(avg((pred = label)::INT), 6) AS f1 FROM ({v_class}) t")
def f1_micro(i):
    return r6(ev.f1(i.view("v_class"), "micro"), "f1")


@query(f"WITH {CLASSES} SELECT round(avg(f1), 6) AS f1 FROM f")
def f1_macro(i):
    return r6(ev.f1(i.view("v_class"), "macro"), "f1")


@query(f"WITH {CLASSES} SELECT round(sum(f1 * support) / sum(support), 6) AS f1 FROM f")
def f1_weighted(i):
    return r6(ev.f1(i.view("v_class"), "weighted"), "f1")


WORDS = f"w AS (SELECT doc_id, list_filter(string_split({c('pred')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({c('label')}, ' '), lambda x: x <> '') AS r FROM ({{v_pairs}}) t)"


def _grams(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))"


BLEU = f"""WITH {WORDS}, g AS (SELECT *, {', '.join(f"{_grams(x, n)} AS {x}{n}" for x in 'pr' for n in range(1, 5))} FROM w),
 s AS (SELECT *, {', '.join(f"CASE WHEN len(p{n}) = 0 THEN 0 ELSE len(list_filter(p{n}, lambda x: list_contains(r{n}, x))) / len(p{n}) END AS s{n}" for n in range(1, 5))} FROM g),
 b AS (SELECT doc_id, CASE WHEN least(s1, s2, s3, s4) = 0 THEN 0 ELSE exp((ln(s1) + ln(s2) + ln(s3) + ln(s4)) / 4) * CASE WHEN len(p) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(p)) END END AS bleu FROM s)"""


@query(BLEU + " SELECT round(avg(bleu), 6) AS bleu FROM b")
def bleu(i):
    return r6(ev.compute(i.view("v_pairs"), ["bleu", "no_such_metric"]), "bleu")


@query(BLEU + " SELECT doc_id, round(bleu, 6) AS bleu FROM b")
def bleu_rows(i):
    return ev.row_scores(i.view("v_pairs"), ["bleu"]).select("doc_id", F.round("_bleu", 6).alias("bleu"))


def _rouge(n: int) -> str:
    p, r = f"list_distinct({_grams('p', n)})", f"list_distinct({_grams('r', n)})"
    return f"WITH {WORDS}, g AS (SELECT {p} AS a, {r} AS b FROM w) SELECT round(avg(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END), 6) AS rouge_{n} FROM g"


@query(_rouge(1))
def rouge_1(i):
    return r6(ev.compute(i.view("v_pairs"), ["rouge_1"]), "rouge_1")


@query(_rouge(2))
def rouge_2(i):
    return r6(ev.compute(i.view("v_pairs"), ["rouge_2"]), "rouge_2")


@query()
def rouge_l(i):
    return r6(ev.compute(i.view("v_pairs"), ["rouge_l"]), "rouge_l")


@query("SELECT round(avg((lower(trim(pred)) = lower(trim(label)))::INT), 6) AS accuracy FROM ({v_pairs}) t")
def vqa_text_accuracy(i):
    return r6(i.view("v_pairs").agg(F.avg((t.normalised_answer(F.col("pred")) == t.normalised_answer(F.col("label"))).cast("double")).alias("accuracy")), "accuracy")


@query("SELECT round(sum(len(list_filter(range(1, least(length(pred), length(label)) + 1), lambda i: substr(pred, i, 1) = substr(label, i, 1)))) / sum(length(pred)), 6) AS accuracy FROM ({v_pairs}) t")
def flat_token_accuracy(i):
    ids = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda k: F.ascii(F.substr(F.col(x), k, F.lit(1))))).otherwise(F.array().cast("array<int>"))
    v = i.view("v_pairs").select(ids("pred").alias("p"), ids("label").alias("r"))
    return r6(ev.flat_token_accuracy(v, "p", "r"), "accuracy")


ANSWERS = """scored AS (SELECT *, CASE WHEN lower(trim(answer, ' ' || chr(10))) = lower(trim(ground_truth, ' ' || chr(10))) THEN 1.0::DOUBLE
   WHEN contains(lower(trim(answer, ' ' || chr(10))), lower(trim(ground_truth, ' ' || chr(10)))) OR contains(lower(trim(ground_truth, ' ' || chr(10))), lower(trim(answer, ' ' || chr(10)))) THEN 0.5 ELSE 0 END AS score FROM ({v_tasks}) t),
 summary AS (SELECT benchmark, count(*) AS total, count(*) FILTER (score = 1) AS correct, avg((score = 1)::INT) AS accuracy, avg(score) AS average_score, count(*) FILTER (score < 1) AS failed FROM scored GROUP BY benchmark)"""


@query(f"WITH {ANSWERS} SELECT item_id, score, score = 1 AS is_correct FROM scored")
def answer_scores(i):
    return ev.scored_answers(i.view("v_tasks")).select("item_id", "score", "is_correct")


@query(f"WITH {ANSWERS} SELECT benchmark, total, correct, round(accuracy, 6) AS accuracy, round(average_score, 6) AS average_score, failed FROM summary")
def bench_summary(i):
    return r6(ev.benchmark_summary(ev.scored_answers(i.view("v_tasks"))), "accuracy", "average_score")


@query(f"WITH {ANSWERS} SELECT item_id, score FROM scored WHERE score < 1")
def failed_cases(i):
    return ev.failed_cases(ev.scored_answers(i.view("v_tasks"))).select("item_id", "score")


@query(f"WITH {ANSWERS} SELECT count(*) AS benchmarks, round(avg(accuracy), 6) AS overall_accuracy, count(*) FILTER (accuracy < 0.7) AS poor FROM summary")
def bench_report(i):
    return r6(ev.report(ev.benchmark_summary(ev.scored_answers(i.view("v_tasks")))), "overall_accuracy")


@query(f"WITH {ANSWERS} SELECT benchmark, round(accuracy, 6) AS accuracy FROM summary WHERE accuracy < 0.7")
def poor_performers(i):
    return r6(ev.poor_performers(ev.benchmark_summary(ev.scored_answers(i.view("v_tasks")))).select("benchmark", "accuracy"), "accuracy")


@query(f"WITH {ANSWERS} SELECT benchmark, count(*) FILTER (item_id % 7 > 1) AS processed, count(*) FILTER (item_id % 7 = 0) AS skipped, count(*) FILTER (item_id % 7 = 1) AS errors, count(*) FILTER (item_id % 7 > 1 AND score = 1) AS correct FROM scored GROUP BY benchmark")
def run_counters(i):
    rows = ev.scored_answers(i.view("v_tasks")).withColumn("status", F.expr("CASE item_id % 7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'error' ELSE 'ok' END"))
    return ev.run_counters(rows)


@query("SELECT 'task_' || item_id AS task_id, trim(question, ' ' || chr(10)) AS question, trim(ground_truth, ' ' || chr(10)) AS ground_truth, benchmark FROM ({v_tasks}) t WHERE item_id % 5 > 0")
def task_convert(i):
    v = i.view("v_tasks").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("question")).alias("question"), F.when(F.col("item_id") % 5 > 0, F.col("question")).alias("text"), "ground_truth", "benchmark")
    v = v.withColumn("question", F.when(F.col("item_id") % 5 > 0, F.col("question")))
    return ev.to_tasks(v, "item_id", ["benchmark"]).select("task_id", "question", "ground_truth", F.col("metadata")["benchmark"].alias("benchmark"))


@query("SELECT o_orderkey, o_custkey, first_line FROM (SELECT o.o_orderkey, o.o_custkey, e.event_type AS first_line, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY e.event_id) AS rn FROM orders o LEFT JOIN events e ON e.user_id = o.o_custkey) t WHERE rn = 1")
def first_match_left_join(i):
    events = i.table("events").select("event_id", "user_id", F.col("event_type").alias("first_line"))
    return ev.first_match(i.table("orders").select("o_orderkey", "o_custkey"), events, "o_custkey", "user_id", ["event_id"], ["first_line"])


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 = 0")
def taxonomy_select(i):
    fields = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("topic"), F.lit("skill"))).otherwise(F.array(F.lit("year")))
    return ev.select_benchmarks(i.table("nation").select(F.col("n_name").alias("name"), fields.alias("native_taxonomy_fields")), fields=["skill", "level"]).select("name")


@query("SELECT n_name AS name, n_nationkey IN (SELECT s_nationkey FROM supplier) AS known FROM nation")
def name_select(i):
    asked = i.table("nation").select(F.col("n_name").alias("name"), "n_nationkey")
    catalog = i.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    known = asked.join(catalog, "n_nationkey", "left_semi").withColumn("known", F.lit(True))
    return known.unionByName(asked.join(catalog, "n_nationkey", "left_anti").withColumn("known", F.lit(False))).select("name", "known")


def _ranked(group: str, key: str = "doc_id", frm: str = "({v_class}) t") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5('42:' || {key}), {key}) AS rank, count(*) OVER (PARTITION BY {group}) AS size FROM {frm}"


@query(f"SELECT doc_id, label, rank FROM ({_ranked('label')}) r WHERE rank <= 50")
def cluster_sample(i):
    return sampling.sample_each(i.view("v_class"), "label", 50, "doc_id").select("doc_id", "label", "rank")


@query(f"SELECT doc_id, label FROM ({_ranked('label')}) r WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM ({{v_class}}) t GROUP BY label) m)")
def undersample(i):
    return sampling.undersample(i.view("v_class"), "label", "doc_id").select("doc_id", "label")


@query("SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM ({v_class}) t GROUP BY label) m) AS n, count(*) AS originals FROM ({v_class}) t GROUP BY label")
def oversample_counts(i):
    return sampling.oversample(i.view("v_class"), "label", "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("copy") == 0).alias("originals"))


SPLIT = "CASE WHEN rank <= floor(size * 0.8::DOUBLE) THEN 'train' WHEN rank <= floor(size * 0.8::DOUBLE) + floor(size * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"


@query(f"SELECT doc_id, {SPLIT} AS split FROM ({_ranked('1')}) r")
def split_global(i):
    return sampling.split(i.view("v_class"), "doc_id").select("doc_id", "split")


@query(f"SELECT doc_id, label, {SPLIT} AS split FROM ({_ranked('label')}) r")
def split_stratified(i):
    return sampling.split(i.view("v_class"), "doc_id", stratum="label").select("doc_id", "label", "split")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p_partkey < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM part, (SELECT count(*) AS n FROM part) c")
def grpo_split(i):
    return sampling.ordered_split(i.table("part").select(F.col("p_partkey").alias("id")), "id", (0.7, 0.2)).select("id", "split")


NW = "len(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
QW, AW = NW.replace("{0}", c("question")), NW.replace("{0}", c("answer"))


@query(
    f"""SELECT conv_id, count(*) AS turns, round(avg({QW}), 6) AS q_words_mean, round(stddev_pop({QW}), 6) AS q_words_std, round(avg(length(question)), 6) AS q_chars_mean,
    round(avg({AW}), 6) AS a_words_mean, round(stddev_pop({AW}), 6) AS a_words_std, round(avg(length(answer)), 6) AS a_chars_mean FROM ({{v_turns}}) t GROUP BY conv_id"""
)
def dialogue_stats(i):
    d = features.dialogue_statistics(i.view("v_turns"))
    return r6(d, *[n for n in d.columns if n.endswith(("mean", "std"))])


WSET = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda x: x <> ''))"


@query(
    f"""WITH x AS (SELECT *, lead(question) OVER (PARTITION BY conv_id ORDER BY idx) AS nxt, {QW} AS qw, {AW} AS aw FROM ({{v_turns}}) t),
    s AS (SELECT *, {WSET.replace('{0}', c('question'))} AS qa, {WSET.replace('{0}', c('nxt'))} AS qb FROM x),
    n AS (SELECT *, CASE WHEN nxt IS NULL THEN NULL WHEN len(qa) = 0 OR len(qb) = 0 THEN 0 ELSE len(list_intersect(qa, qb)) / len(list_distinct(list_concat(qa, qb))) END AS near FROM s)
    SELECT conv_id, max(contains(question, '<image>')::INT) AS image_ref, round(coalesce(avg(near), 0), 6) AS coherence, round(coalesce(stddev_pop(near), 0), 6) AS coherence_std,
    round(avg(qw) / 50, 6) AS q_scaled, round(avg(aw) / 100, 6) AS a_scaled, round(sum(aw) / sum(qw), 6) AS ratio FROM n GROUP BY conv_id"""
)
def coherence(i):
    return r6(features.interaction(i.view("v_turns")), "coherence", "coherence_std", "q_scaled", "a_scaled", "ratio")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(i):
    e = i.table("embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(a.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(v) AS m, count(*) AS n FROM x GROUP BY label, d) SELECT label, max(n) AS n, round(sum(m), 5) AS total, round(max(CASE WHEN d = 1 THEN m END), 5) AS first FROM m GROUP BY label")
def mean_pool(i):
    p = features.mean_pool(i.table("embeddings"), "label")
    return p.select("label", "n", F.round(a.total(F.col("pooled")), 5).alias("total"), F.round(F.col("pooled")[0], 5).alias("first"))


def _standard(group: str) -> str:
    return f"""WITH x AS (SELECT vec_id, {group} AS g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
    z AS (SELECT vec_id, d, (v - avg(v) OVER (PARTITION BY g, d)) / stddev_pop(v) OVER (PARTITION BY g, d) AS z FROM x)
    SELECT vec_id, round(sum(z), 5) AS total, round(max(CASE WHEN d = 1 THEN z END), 5) AS first FROM z GROUP BY vec_id"""


def _standard_rows(df):
    return df.select("vec_id", F.round(a.total(F.col("z")), 5).alias("total"), F.round(F.col("z")[0], 5).alias("first"))


@query(_standard("0"))
def standardize(i):
    return _standard_rows(features.standardise(i.table("embeddings"), "vec_id"))


@query(_standard("vec_id // 100"))
def standardize_batched(i):
    return _standard_rows(features.standardise(i.table("embeddings"), "vec_id", batch=100))


@query("SELECT conv_id, max(contains(lower(text), 'turn')::INT) AS is_turn, bool_or(contains(text, '<image>') OR contains(text, '[Image_')) AS image_ref FROM conversations GROUP BY conv_id")
def task_flags(i):
    v = i.table("conversations")
    return v.select("conv_id", *features.task_flags(F.col("text")), features.mentions_image(F.col("text")).alias("m")).groupBy("conv_id").agg(F.max("is_turn").alias("is_turn"), F.max("m").alias("image_ref"))


@query("SELECT c_mktsegment AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM customer GROUP BY c_mktsegment")
def cluster_sizes(i):
    n = i.table("customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    total = i.table("customer").agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percentage"))
