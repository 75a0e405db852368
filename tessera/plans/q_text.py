"""Queries of cleaning, conversion and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import cleaning, scoring
from tessera.plans.registry import query

CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def c(x: str) -> str:
    return CLEAN.replace("{0}", x)


@query(f"SELECT doc_id, {c('text')} AS text, length({c('text')}) AS n FROM documents")
def clean_text(i):
    return i.table("documents").select("doc_id", t.clean_text(F.col("text")).alias("text")).withColumn("n", F.length("text").cast("long"))


@query(f"SELECT conv_id, idx, {c('question')} AS question, {c('answer')} AS answer FROM ({{v_turns}}) t")
def clean_vqa(i):
    return cleaning.clean(i.view("v_turns"), "vqa").select("conv_id", "idx", "question", "answer")


@query(f"SELECT doc_id, {c('text')} AS text, label, pred FROM ({{v_class}}) t")
def clean_classification(i):
    return cleaning.clean(i.view("v_class"), "classification")


@query(f"SELECT item_id, {c('text')} AS caption FROM benchmark")
def clean_captions(i):
    return cleaning.clean(i.table("benchmark"), "image_captioning").select("item_id", "caption")


@query("SELECT c_custkey, trim(c_name) AS c_name, trim(c_mktsegment) AS c_mktsegment FROM customer")
def clean_all_text(i):
    return cleaning.clean(i.table("customer"), "other").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT item_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 50) || chr(10) || '...' || chr(10) || right(text, 50) ELSE text END AS cut FROM benchmark")
def truncate_middle(i):
    return i.table("benchmark").select("item_id", t.truncate_middle(F.col("text"), 100).alias("cut"))


DEFAULTS = "CASE WHEN idx % 3 = 0 THEN '  ' ELSE {0} END"


@query(f"SELECT conv_id, idx, coalesce(nullif(trim({DEFAULTS.format('question')}, ' ' || chr(10)), ''), 'What is in the image?') AS q, coalesce(nullif(trim({DEFAULTS.format('answer')}, ' ' || chr(10)), ''), 'unknown') AS a FROM ({{v_turns}}) t")
def default_qa(i):
    v = i.view("v_turns")
    blank = lambda name: F.when(F.col("idx") % 3 == 0, "  ").otherwise(F.col(name))
    return v.select("conv_id", "idx", t.default_question(blank("question")).alias("q"), t.default_answer(blank("answer")).alias("a"))


OPTIONS = """opts AS (SELECT *, nullif(trim(a), '') AS oa, nullif(trim(b), '') AS ob, nullif(trim(c), '') AS oc, nullif(trim(d), '') AS od FROM ({v_opts}) v)"""
QUESTION = "concat_ws(chr(10), trim(question), nullif(trim(hint), ''), 'A: ' || oa, 'B: ' || ob, 'C: ' || oc, 'D: ' || od)"
_LETTERS = {"A": "a", "B": "b", "C": "c", "D": "d"}


@query(f"WITH {OPTIONS} SELECT id, CASE WHEN question IS NOT NULL THEN {QUESTION} END AS q FROM opts")
def build_question(i):
    v = i.view("v_opts")
    return v.select("id", t.build_question(F.col("question"), F.col("hint"), t.option_map({k: F.col(x) for k, x in _LETTERS.items()})).alias("q"))


ANSWER = """CASE trim(answer) WHEN 'A' THEN coalesce(oa, 'A') WHEN 'b, C' THEN coalesce(nullif(concat_ws('; ', ob, oc), ''), 'b, C')
    WHEN 'A,D' THEN coalesce(nullif(concat_ws('; ', oa, od), ''), 'A,D') WHEN 'BA' THEN coalesce(nullif(concat_ws('; ', ob, oa), ''), 'BA') ELSE trim(answer) END"""


@query(f"WITH {OPTIONS} SELECT id, {ANSWER} AS a FROM opts")
def answer_letters(i):
    v = i.view("v_opts")
    return v.select("id", t.answer_text(F.col("answer"), t.option_map({k: F.col(x) for k, x in _LETTERS.items()})).alias("a"))


@query(f"WITH {OPTIONS} SELECT id, {QUESTION} AS q, {ANSWER} AS a FROM opts WHERE question IS NOT NULL")
def option_rows(i):
    return cleaning.option_rows(i.view("v_opts"), _LETTERS).select("id", "q", "a")


@query(f"WITH {OPTIONS} SELECT id, {QUESTION} AS q, trim(answer) AS a FROM opts WHERE question IS NOT NULL")
def option_rows_letters(i):
    return cleaning.option_rows(i.view("v_opts"), _LETTERS, convert_letters=False).select("id", "q", "a")


IMAGE = "CASE item_id % 6 WHEN 0 THEN 'https://h/' || item_id WHEN 1 THEN base64(encode(text)) WHEN 2 THEN 'data:image/png;base64,' || base64(encode(text)) WHEN 3 THEN 'img/' || item_id || '.png' WHEN 4 THEN '/abs/' || item_id ELSE '' END"


def _images(i):
    x = F.col("item_id").cast("string")
    return i.table("benchmark").select(
        "item_id", "text", F.expr("CASE item_id % 6 WHEN 0 THEN 'https://h/' || item_id WHEN 1 THEN replace(base64(text), '\r\n', '') WHEN 2 THEN 'data:image/png;base64,' || replace(base64(text), '\r\n', '') WHEN 3 THEN 'img/' || item_id || '.png' WHEN 4 THEN '/abs/' || item_id ELSE '' END").alias("img"), x.alias("x")
    )


@query("SELECT item_id, item_id % 6 IN (1, 2) AS b64 FROM benchmark")
def base64_valid(i):
    return _images(i).select("item_id", t.is_base64(F.col("img")).alias("b64"))


@query("SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'base64' WHEN 2 THEN 'base64' WHEN 5 THEN 'empty' ELSE 'path' END AS kind FROM benchmark")
def image_kind(i):
    return _images(i).select("item_id", t.image_kind(F.col("img")).alias("kind"))


@query("SELECT item_id, CASE WHEN item_id % 6 IN (1, 2) THEN text END AS decoded FROM benchmark")
def decode_base64(i):
    return _images(i).select("item_id", F.when((F.col("item_id") % 6).isin(1, 2), F.decode(t.decode_base64(F.col("img")), "UTF-8")).alias("decoded"))


@query(f"SELECT item_id, CASE item_id % 6 WHEN 3 THEN 'root/img/' || item_id || '.png' WHEN 5 THEN 'root/' ELSE img END AS path FROM (SELECT item_id, {IMAGE} AS img FROM benchmark) t")
def resolve_path(i):
    return _images(i).select("item_id", t.resolve_path(F.col("img"), "root").alias("path"))


@query(f"SELECT item_id, CASE item_id % 6 WHEN 1 THEN 'data:image/jpeg;base64,' || img WHEN 2 THEN img END AS uri FROM (SELECT item_id, {IMAGE} AS img FROM benchmark) t")
def data_uri(i):
    return _images(i).select("item_id", t.as_data_uri(F.col("img")).alias("uri"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'unknown' END AS kind FROM benchmark")
def image_format(i):
    head = F.expr("CASE item_id % 4 WHEN 0 THEN X'FFD8FFE000104A4649460001' WHEN 1 THEN X'89504E470D0A1A0A0000000D' WHEN 2 THEN X'524946460000000057454250' ELSE X'000102030405060708090A0B' END")
    return i.table("benchmark").select("item_id", t.image_format(head).alias("kind"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN 'alt' ELSE '' END AS general FROM (SELECT c_custkey AS id, c_name AS name FROM customer) t")
def metric_alias(i):
    v = i.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("g1"), F.when(F.col("c_custkey") % 3 == 1, "alt").otherwise("").alias("g2"))
    return v.select("id", F.coalesce(t.first_filled(F.col("g1"), F.col("g2")), F.lit("")).alias("general"))


@query("SELECT id, 'x' || id AS sample_id FROM (SELECT c_custkey AS id FROM customer) t WHERE id % 4 < 3 UNION ALL SELECT c_custkey, 'unknown' FROM customer WHERE c_custkey % 4 = 3")
def sample_id_coalesce(i):
    k = F.concat(F.lit("x"), F.col("c_custkey").cast("string"))
    at = lambda n: F.when(F.col("c_custkey") % 4 == n, k)
    return i.table("customer").select(F.col("c_custkey").alias("id"), F.coalesce(t.first_filled(at(0), at(1), at(2)), F.lit("unknown")).alias("sample_id"))


@query("SELECT count(*) AS n_rows, 0::BIGINT AS missing_id, count(*) FILTER (question IS NULL) AS missing_question, 0::BIGINT AS missing_answer FROM ({v_opts}) t")
def required_fields(i):
    return cleaning.violations(i.view("v_opts"), ["id", "question", "answer"])


@query("SELECT count(*) AS total, min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS avg_length, count(DISTINCT label) AS n_labels FROM ({v_class}) t")
def dataset_stats(i):
    s = cleaning.dataset_statistics(i.view("v_class"), "text", "label")
    return s.withColumns({"min_length": F.col("min_length").cast("long"), "max_length": F.col("max_length").cast("long"), "avg_length": F.round("avg_length", 6)})


@query("SELECT label, count(*) AS n FROM ({v_class}) t GROUP BY label")
def label_dist(i):
    return cleaning.label_histogram(i.view("v_class"), "label")


@query("SELECT sample_id, cap, general, specific FROM ({v_metrics}) t WHERE general <> '' OR specific <> ''")
def drop_empty_metrics(i):
    return i.view("v_metrics").where((F.col("general") != "") | (F.col("specific") != "")).select("sample_id", "cap", "general", "specific")


ALIGNED = """aligned AS (SELECT sample_id, """ + ", ".join(f"coalesce(max(CASE WHEN cap = '{g}' THEN {x} END), {d}) AS {g}_{x}" for g in scoring.GRADERS for x, d in (("corr", "0e0"), ("train", "0e0"), ("corr_conf", "0.5e0"), ("train_conf", "0.5e0"))) + """ FROM ({v_scores}) s GROUP BY sample_id)"""


def _list(x: str) -> str:
    return "[" + ", ".join(f"{g}_{x}" for g in scoring.GRADERS) + "]"


SCORED = (
    ALIGNED
    + f""", dev AS (SELECT *, list_stddev_pop({_list('corr')}) AS corr_std, list_stddev_pop({_list('train')}) AS train_std,
      (weak_corr + weak_train) / 2 AS weak_combined, (normal_corr + normal_train) / 2 AS normal_combined, (sota_corr + sota_train) / 2 AS sota_combined FROM aligned),
    scored AS (SELECT *, (0.7 * corr_std + 0.3 * (list_max({_list('corr')}) - list_min({_list('corr')})) + 0.7 * train_std + 0.3 * (list_max({_list('train')}) - list_min({_list('train')}))) / 2 AS difficulty,
      least(1, greatest(0, 0.3 / (1 + corr_std) + 0.3 / (1 + train_std) + 0.2 * list_avg({_list('corr_conf')}) + 0.2 * list_avg({_list('train_conf')}))) AS confidence FROM dev)"""
)


def _scored(i):
    return scoring.score(scoring.align(i.view("v_scores")))


@query(f"WITH {SCORED} SELECT sample_id, round(corr_std, 6) AS corr_std, round(train_std, 6) AS train_std, round(difficulty, 6) AS difficulty, round(confidence, 6) AS confidence FROM scored")
def score_disagreement(i):
    return _scored(i).select("sample_id", *[F.round(x, 6).alias(x) for x in ("corr_std", "train_std", "difficulty", "confidence")])


@query(f"WITH {SCORED} SELECT sample_id, round(difficulty, 6) AS difficulty, round(confidence, 6) AS confidence FROM scored WHERE round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3")
def hard_cases(i):
    return scoring.hard_cases(_scored(i)).select("sample_id", F.round("difficulty", 6).alias("difficulty"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {SCORED} SELECT sample_id, abs(weak_combined - sota_combined) < 2.5 AS keep_weak, abs(normal_combined - sota_combined) < 2.5 AS keep_normal, true AS keep_sota, round(weak_combined, 6) AS weak_combined FROM scored WHERE NOT (round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3)")
def keep_metrics(i):
    return scoring.sample_metrics(_scored(i)).select("sample_id", "keep_weak", "keep_normal", "keep_sota", F.round("weak_combined", 6).alias("weak_combined"))


@query(
    f"""WITH {SCORED}, flagged AS (SELECT *, round(difficulty, 9) >= 3 OR round(greatest(corr_std, train_std), 9) >= 3 AS hard FROM scored),
    pooled AS (SELECT s.n_metrics, CASE WHEN NOT hard AND CASE s.cap WHEN 'weak' THEN abs(weak_combined - sota_combined) < 2.5 WHEN 'normal' THEN abs(normal_combined - sota_combined) < 2.5 ELSE true END THEN s.n_metrics END AS kept
               FROM ({{v_scores}}) s JOIN flagged f USING (sample_id))
    SELECT (SELECT count(*) FROM flagged) AS n_samples, (SELECT count(*) FROM flagged WHERE hard) AS n_hard, CAST((SELECT sum(n_metrics) FROM pooled) AS BIGINT) AS n_metrics,
           CAST((SELECT sum(kept) FROM pooled) AS BIGINT) AS n_kept, round((SELECT avg(difficulty) FROM flagged), 6) AS avg_difficulty, round((SELECT avg(confidence) FROM flagged), 6) AS avg_confidence,
           round((SELECT 1 - sum(kept) / sum(n_metrics) FROM pooled), 6) AS reduction"""
)
def batch_stats(i):
    s = scoring.batch_statistics(_scored(i), i.view("v_scores").select("sample_id", "cap", "n_metrics"))
    return s.withColumns({x: F.round(x, 6) for x in ("avg_difficulty", "avg_confidence", "reduction")})


@query("SELECT doc_id AS sample_id, cap, corr, train, n_metrics FROM documents CROSS JOIN (VALUES ('weak', 7.5::DOUBLE, 7.0::DOUBLE, 2), ('normal', 8.2, 8.5, 3), ('sota', 8.7, 9.0, 5)) g(cap, corr, train, n_metrics)")
def mock_grades(i):
    return scoring.mock_grades(i.table("documents"), "doc_id")


@query("SELECT sample_id, cap, sample_id % 10 = 3 AS is_fallback, CASE WHEN sample_id % 10 = 3 THEN 5 ELSE corr END AS corr, CASE WHEN sample_id % 10 = 3 THEN 0.5 ELSE corr_conf END AS corr_conf FROM ({v_scores}) s")
def fallback_scores(i):
    v = i.view("v_scores")
    lost = v.withColumns({x: F.when(F.col("sample_id") % 10 != 3, F.col(x)) for x in ("corr", "train", "corr_conf", "train_conf")})
    return scoring.with_fallback(lost).select("sample_id", "cap", "is_fallback", "corr", "corr_conf")


REPLY = "CASE c_custkey % 4 WHEN 0 THEN '```json' || chr(10) || '{\"a\": ' || c_custkey || '}' || chr(10) || '```' WHEN 1 THEN 'Well: {\"a\": ' || c_custkey || ', \"b\": {\"c\": 1}} so.' WHEN 2 THEN '{\"a\": ' || c_custkey || '}' ELSE 'no json here' END"


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 3 THEN c_custkey END AS a FROM customer")
def json_repair(i):
    r = i.table("customer").select(F.col("c_custkey").alias("id"), F.expr(REPLY.replace("chr(10)", "'\\n'")).alias("reply"))
    return r.select("id", F.get_json_object(t.reply_json(F.col("reply")), "$.a").cast("long").alias("a"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 3 THEN c_custkey END AS a FROM customer")
def json_greedy(i):
    r = i.table("customer").select(F.col("c_custkey").alias("id"), F.expr(REPLY.replace("chr(10)", "'\\n'")).alias("reply"))
    return r.select("id", F.get_json_object(t.greedy_json(F.col("reply")), "$.a").cast("long").alias("a"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 3e-5 WHEN c_custkey % 3 = 1 THEN 0.1 ELSE c_acctbal END AS x, CASE WHEN c_custkey % 3 = 2 THEN CAST(c_custkey AS INTEGER) ELSE -1 END AS n FROM customer")
def safe_numbers(i):
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN '3e-5' WHEN 1 THEN 'oops' ELSE CAST(c_acctbal AS STRING) END")
    whole = F.expr("CASE c_custkey % 3 WHEN 2 THEN CAST(c_custkey AS STRING) ELSE 'none' END")
    return i.table("customer").select(F.col("c_custkey").alias("id"), F.coalesce(raw.try_cast("double"), F.lit(0.1)).alias("x"), F.coalesce(whole.try_cast("int"), F.lit(-1)).alias("n"))


@query("SELECT item_id, {'b': 'two', 'c': 'id' || item_id}::JSON ->> 'b' AS b, 'id' || item_id AS c, 'one' AS a FROM benchmark")
def metadata_merge(i):
    first = F.create_map(F.lit("a"), F.lit("one"), F.lit("b"), F.lit("one"))
    second = F.create_map(F.lit("b"), F.lit("two"), F.lit("c"), F.concat(F.lit("id"), F.col("item_id").cast("string")))
    merged = i.table("benchmark").select("item_id", t.merged_map(first, second).alias("m"))
    return merged.select("item_id", F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"), F.col("m")["a"].alias("a"))
