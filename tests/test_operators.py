import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.functions import text as t
from tessera.operators import agents, cleaning, clusters, evaluation, history, metric_dedup, rewards, sampling, scoring
from tessera.sources import readers, writers
from tessera.streaming import streams

GOLD = {  # sample: three graders' (corr, corr_conf, train, train_conf), then difficulty, confidence, stds, hard
    "7": ([(9.5, 0.95, 9, 0.90), (9.5, 0.98, 9.5, 0.97), (9.5, 0.95, 9.0, 0.95)], (0.15749579113843054, 0.9227769290508362, 0.0, 0.23570226039551584, False)),
    "1": ([(8.0, 0.95, 7.0, 0.85), (6.5, 0.95, 8.5, 0.90), (4.0, 1.0, 3.0, 1.0)], (2.8149598541380874, 0.580201220740381, 1.6499158227686108, 2.3213980461973533, False)),
    "17": ([(9.0, 0.95, 8.5, 0.90), (7.5, 0.90, 9.0, 0.90), (2.0, 1.0, 2.5, 1.0)], (4.111905055196333, 0.5273789067712239, 3.009245014211298, 2.953340857778225, True)),
}


def test_scoring_goldens(spark):
    rows = [(s, g, float(c), float(cc), float(tr), float(tc)) for s, (three, _) in GOLD.items() for g, (c, cc, tr, tc) in zip(scoring.GRADERS, three, strict=True)]
    df = spark.createDataFrame(rows, "sample_id string, cap string, corr double, corr_conf double, train double, train_conf double")
    for r in scoring.score(scoring.align(df)).collect():
        want = GOLD[r.sample_id][1]
        assert np.allclose((r.difficulty, r.confidence, r.corr_std, r.train_std), want[:4]) and r.is_hard == want[4]


def test_missing_grader_counts_as_zero(spark):
    df = spark.createDataFrame([("x", "sota", 9.0, 0.9, 9.0, 0.9)], "sample_id string, cap string, corr double, corr_conf double, train double, train_conf double")
    r = scoring.score(scoring.align(df)).first()
    assert r.weak_corr == 0.0 and r.weak_corr_conf == 0.5 and r.is_hard


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("answer", "options", "want"), [("A,B", {"A": "x", "B": "y"}, "x; y"), ("AZ", {"A": "x"}, "AZ"), ("cat", {"A": "x"}, "cat"), ("H", {"A": "x"}, "H"), (" b、a ", {"A": "x", "B": "y"}, "y; x")])
def test_answer_letters(spark, answer, options, want):
    assert one(spark, t.answer_text(F.lit(answer), F.create_map(*[F.lit(v) for kv in options.items() for v in kv]))) == want


def test_build_question_and_truncate(spark):
    assert one(spark, t.build_question(F.lit("Q"), F.lit("h"), F.create_map(F.lit("A"), F.lit("x")))) == "Q\nh\nA: x"
    assert one(spark, t.build_question(F.lit(None).cast("string"), F.lit("h"), F.create_map(F.lit("A"), F.lit("x")))) is None
    assert one(spark, F.length(t.truncate_middle(F.lit("x" * 2001)))) == 2005
    assert one(spark, t.clean_text(F.lit("　 a \t b\n"))) == "a b"


@pytest.mark.parametrize(("answer", "truth", "want"), [("Cat ", "cat", 1.0), ("a cat", "cat", 0.5), ("", "cat", 0.5), ("dog", "cat", 0.0)])
def test_answer_score(spark, answer, truth, want):
    assert one(spark, evaluation.answer_score(F.lit(answer), F.lit(truth))) == want


def test_rewards(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, a.set_f1(arr("a", "b"), arr("b", "c"))) == 0.5
    assert one(spark, a.set_f1(arr(), arr())) == 1.0 and one(spark, a.set_f1(arr(), arr("a"))) == 0.0
    assert one(spark, metric_dedup.word_overlap(F.lit("a b c"), F.lit("b c d"))) == 0.5
    assert one(spark, metric_dedup.word_overlap(F.lit(""), F.lit("a"))) == 0.0
    alone = rewards.group_advantage(spark.createDataFrame([("p", 2.0)], "p string, r double"), "p", "r").first()
    assert alone.advantage == 0.0


def test_selection_prompts_last_wins(spark):
    text = "<selection><reasoning>r</reasoning><agents><agent><name>a</name><prompt>1</prompt></agent><agent><name>a</name><prompt>2</prompt></agent></agents></selection>"
    assert one(spark, t.selection_agents(F.lit(text))) == ["a", "a"]
    assert one(spark, t.selection_prompts(F.lit(text))) == {"a": "2"}
    assert one(spark, t.selection_well_formed(F.lit(text))) == 1.0


def test_metrics_demo(spark):
    df = spark.createDataFrame([("hello world", "hello world"), ("foo bar", "foo baz"), ("test", "test")], "pred string, label string")
    r = evaluation.compute(df, ["accuracy", "exact_match", "rouge_l", "nothing"]).first()
    assert abs(r.accuracy - 2 / 3) < 1e-12 and abs(r.exact_match - 2 / 3) < 1e-12 and "nothing" not in r.asDict()
    assert abs(evaluation.f1(df, "macro").first().f1 - 2 / 3) < 1e-12


def brute_lcs(x, y):
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            d[i + 1][j + 1] = d[i][j] + 1 if p == q else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=12), st.text("ab c", max_size=12)), min_size=1, max_size=8))
def test_text_metric_properties(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, r string")
    scored = evaluation.row_scores(df, ["bleu", "rouge_l", "rouge_1"], "p", "r")
    got = scored.select("p", "r", F.col("_bleu").alias("b"), F.col("_rouge_l").alias("l"), F.col("_rouge_1").alias("s"), evaluation.common_subsequence("_p", "_r").alias("n")).collect()
    for x in got:
        assert 0 <= x.b <= 1 + 1e-9 and 0 <= x.l <= 1 + 1e-9 and 0 <= x.s <= 1 and (x.p != x.r or x.s == (1.0 if x.p.split() else 0.0))
        assert x.n == brute_lcs(x.p.split(), x.r.split())


def test_token_operators(spark):
    ids = F.array(*[F.lit(v).cast("long") for v in (5, 6, -100)])
    assert one(spark, a.shift_right(ids, 1, 0)) == [1, 5, 6]
    assert one(spark, a.completion_mask(F.array(F.lit(4), F.lit(2), F.lit(9)), 2)) == [1, 1, 0]
    assert one(spark, a.pad_right(F.array(F.lit(4).cast("long")), F.lit(3))) == [4, 0, 0]
    assert one(spark, history.batch_size(F.lit(13))) == 8


def test_splits_are_complete_and_exact(spark):
    df = spark.range(10).withColumn("label", F.when(F.col("id") < 7, "a"))
    counts = lambda d: {r.split: r["count"] for r in d.groupBy("split").count().collect()}
    assert counts(sampling.split(df, "id")) == {"train": 8, "val": 1, "test": 1}
    assert sampling.split(df, "id", stratum="label").count() == 10
    assert counts(sampling.ordered_split(spark.range(4), "id", (0.7, 0.2))) == {"train": 2, "test": 2}
    assert sampling.sample_each(df, "label", 2, "id").groupBy("label").count().toPandas()["count"].tolist() == [2, 2]
    over = sampling.oversample(df, "label", "id").groupBy("label").count().toPandas()["count"].tolist()
    assert over == [7, 7] and sampling.undersample(df, "label", "id").count() == 6


def test_next_version(spark):
    v = spark.createDataFrame([("v20240101_001",), ("v20240101_003",), ("v20230101_009",)], "version string")
    assert history.next_version(v, "20240101").first().version == "v20240101_004"
    assert history.next_version(v, "20250101").first().version == "v20250101_001"


def test_task_detection_and_validation(spark):
    assert cleaning.detect_task(["question", "answer"]) == "vqa" and cleaning.detect_task(["image", "caption"]) == "image_captioning"
    assert cleaning.detect_task(["source", "target"]) == "seq2seq" and cleaning.detect_task(["x"]) == "classification"
    assert cleaning.required_fields("vqa") == ("image", "question", "answer")
    df = spark.range(1)
    assert cleaning.is_valid(df, ["id"]) and not cleaning.is_valid(df, ["id", "x"]) and not cleaning.is_valid(df.limit(0), ["id"])


def test_first_fit_is_ordered_and_idempotent(spark):
    items = [("accuracy of the answer", "count right answers"), ("accuracy of the answers given", "count right answers"), ("image quality", "sharpness")]
    same = lambda x, y: float(x.split()[:1] == y.split()[:1])
    merged = metric_dedup.first_fit(items, same, 0.6, 0.9)
    assert [m[0] for m in merged] == ["accuracy of the answers given", "image quality"]
    again = metric_dedup.first_fit([(g, s[0]) for g, s in merged], same, 0.6, 0.9)
    assert [m[0] for m in again] == [m[0] for m in merged]


def test_column_tfidf_equals_plain(spark):
    pairs = [("the cat sat on a mat", "a cat sat"), ("the of", "a"), ("dog dog cat", "cat dog"), ("x", "y")]
    stops = metric_dedup.stop_words()
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", metric_dedup.similarity(F.col("x"), F.col("y"), stops).alias("s"))
    for r in df.collect():
        assert math.isclose(r.s, metric_dedup.text_similarity(r.x, r.y, stops), abs_tol=1e-9)


def test_agents(spark):
    plan = spark.createDataFrame([([("a", None, None, "do a", None), ("b", None, None, None, "do b")],)], "agents array<struct<name:string,specialty:array<string>,suggested_models:array<string>,prompt_scaffold:string,prompt:string>>")
    listed = agents.plan_agents(plan)
    assert {r.agent: r.prompt for r in listed.collect()} == {"a": "do a", "b": "do b"}
    assert agents.build_tasks(spark.range(3), listed, "id", ["id"]).count() == 6
    with pytest.raises(ValueError, match="unknown"):
        agents.registry({"x": {"type": "none"}}, {})
    calls = []

    def flaky(agent, prompt):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return {"text": "ok"}

    assert agents.with_retries(flaky, 2, 0)("a", "p") == {"text": "ok"}


def test_dendrogram_cut():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    for linkage in ("ward", "single", "complete", "average"):
        merges = clusters.dendrogram(x, linkage)
        assert clusters.cut(merges, 5, k=3).tolist() == [0, 0, 1, 1, 2]
    assert clusters.cut(clusters.dendrogram(x, "single"), 5, height=1.0).tolist() == [0, 0, 1, 1, 2]
    assert clusters.cut(clusters.dendrogram(x), 5, k=5).tolist() == [0, 1, 2, 3, 4]


def test_choose_k(spark):
    rows = [(k, [float(k % 3) * 10 + 0.01 * k, float(k % 3)]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    k, scores = clusters.choose_k(df, "id", 2, 5)
    assert len(scores) == 4 and k in (2, 3, 4, 5)
    assert clusters.without_noise(spark.createDataFrame([(-1,), (0,)], "label int")).count() == 1


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{bad\n{"id": 2}\n')
    assert readers.jsonl(spark, f"{tmp_path}/a.jsonl", "id long", strict=False).count() == 2
    assert readers.rejected(spark, f"{tmp_path}/a.jsonl", "id long").count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.jsonl(spark, f"{tmp_path}/a.jsonl", "id long").collect()
    (tmp_path / "d.json").write_text('{"data": [{"id": 1}, {"id": 2}]}')
    assert readers.json_data(spark, f"{tmp_path}/d.json", "id long").count() == 2
    assert readers.json_data(spark, f"{tmp_path}/none.json", "id long").count() == 0
    (tmp_path / "t.txt").write_text("a\n\n b \n")
    assert [(r.id, r.text) for r in readers.text_lines(spark, f"{tmp_path}/t.txt").orderBy("id").collect()] == [(0, "a"), (2, "b")]
    with pytest.raises(ValueError, match="unsupported"):
        readers.load(spark, "x.bin")
    df = spark.createDataFrame([("a|b\nc", 1)], "x string, y int")
    assert "a\\|b<br>c" in writers.preview_markdown(df) and "<td>a|b<br>c</td>" in writers.preview_html(df)


def test_stream_equals_batch(spark, tmp_path, sf):
    source = spark.read.parquet(f"{sf}/customer.parquet")
    source.repartition(3).write.json(f"{tmp_path}/in")
    schema = source.schema
    seen = []
    streams.run_batches(streams.jsonl_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/check", lambda df, n: seen.append(df.count()))
    assert sum(seen) == source.count() and len(seen) >= 3


def test_declared_schemas_parse(spark):
    from pyspark.sql import types as T

    from tessera import schemas

    for name in dir(schemas):
        if name.isupper() and name not in ("TURN", "IMAGE", "METRIC", "MERGED_METRIC"):
            assert len(T.StructType.fromDDL(getattr(schemas, name)).fields) > 0
    assert len(T.StructType.fromDDL(schemas.EVALUATION_TRIPLE)["sota"].dataType.fields) == 13


def test_cluster_and_evaluation_readers(spark, tmp_path):
    import json

    sample = {"sample_id": 3, "cluster_id": 0, "data": {"dialogue": [{"question": "q", "answer": "a"}], "image_buffer_list": [], "image_id_list": ["i"], "task_type": "vqa", "source": "s"}}
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"total_samples": 1, "n_clusters": 1, "algorithm": "k"}, "clusters": [{"cluster_id": 0, "size": 1, "percentage": 100.0, "samples": [sample]}]}))
    assert readers.clusters(spark, f"{tmp_path}/c.json").first().data.dialogue[0].question == "q"
    one_file = {"cluster_id": 0, "cluster_size": 1, "sample_size": 1, "sampling_strategy": "random", "samples": [{"sample_id": "3", "image_base64": [], "dialogue": [], "metadata": {"cluster_id": 0, "source": "s", "task_type": "t", "image_id_list": []}}]}
    (tmp_path / "cluster_0_samples.json").write_text(json.dumps(one_file))
    r = readers.cluster_samples(spark, f"{tmp_path}/cluster_*_samples.json").first()
    assert r.sample_id == "3" and r.file == "cluster_0_samples.json"
    grader = lambda c: {"correctness_score": c, "correctness_confidence": 0.9, "training_quality_score": c, "training_quality_confidence": 0.9, "recommended_metrics": []}
    (tmp_path / "e.json").write_text(json.dumps([{"weak": {**grader(3.0), "sample_id": "7"}, "normal": grader(4.0), "sota": grader(9.0)}]))
    rows = readers.grader_rows(readers.evaluation_triples(spark, f"{tmp_path}/e.json"))
    assert rows.count() == 3 and rows.first().sample_id == "7"
    (tmp_path / "b.json").write_text(json.dumps({"benchmarks": [{"name": "x", "note": "old"}, {"name": "x", "note": "new"}]}))
    assert readers.benchmark_catalog(spark, f"{tmp_path}/b.json").first().note == "new"


def test_tfidf_finds_its_terms_once(spark, capsys):
    df = spark.createDataFrame([("a cat sat", "a dog sat")], "x string, y string")
    df.select(metric_dedup.tfidf_cosine(F.col("x"), F.col("y"), metric_dedup.stop_words()).alias("c")).explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 2  # one for each text, none inside the lambdas


def test_deduplicate_takes_groups_over_batches(spark):
    rows = [(f"g{n % 3}", n, f"share of part {n % 5}", "") for n in range(90)]
    df = spark.createDataFrame(rows, "g string, k long, general string, specific string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = metric_dedup.deduplicate(df, "g", ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = metric_dedup.first_fit([(r[2], "") for r in rows if r[0] == "g0"], lambda x, y: metric_dedup.text_similarity(x, y, metric_dedup.stop_words()), 0.7, 0.7)
    assert {g: sum(r.grp == g for r in found) for g in ("g0", "g1", "g2")}["g0"] == len(plain)
    assert len({(r.grp, r.position) for r in found}) == len(found)
