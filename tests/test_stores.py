import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import workdir
from tessera.operators import cleaning, clusters, evaluation, features, metric_dedup, models, scoring
from tessera.operators.graph import distances
from tessera.sources import readers, registry, writers


def plain_dendrogram(x, linkage):
    """Merges by looking through the whole matrix each time."""
    groups = {k: [k] for k in range(len(x))}
    d = distances(x, x)

    def gap(a, b):
        if linkage == "ward":
            ca, cb = x[a].mean(axis=0), x[b].mean(axis=0)
            return float(np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()))
        own = d[np.ix_(a, b)]
        return float({"single": own.min, "complete": own.max, "average": own.mean}[linkage]())

    out, n = [], len(x)
    while len(groups) > 1:
        h, p, q = min((gap(a, b), p, q) for p, a in groups.items() for q, b in groups.items() if p < q)
        out.append((p, q, h))
        groups[n] = groups.pop(p) + groups.pop(q)
        n += 1
    return out


@pytest.mark.parametrize("linkage", ["ward", "single", "complete", "average"])
def test_dendrogram_equals_plain(linkage):
    x = np.random.default_rng(3).normal(size=(40, 3))
    got, want = clusters.dendrogram(x, linkage), plain_dendrogram(x, linkage)
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])


def blobs(n, k=4):
    r = np.random.default_rng(5)
    return [(i, (np.eye(k)[i % k] * 20 + r.normal(size=k) * 0.5).tolist()) for i in range(n)]


def agree(rows, labels, k=4):
    pairs = {(i % k, labels[i]) for i, _ in rows}
    return len(pairs) == k == len({b for _, b in pairs})


def test_hierarchical_chooses_k(spark):
    rows = blobs(120)
    df = spark.createDataFrame([*rows, (500, None)], "key long, embedding array<double>")
    for most in (5000, 60):
        labelled, k, scores = clusters.hierarchical(df, "key", 2, 8, most=most)
        assert k == 4 and len(scores) == 7
        assert agree(rows, {r.key: r.label for r in labelled.collect()})
    assert clusters.hierarchical(df.limit(0), "key")[0].count() == 0


def test_mini_batch_kmeans_finds_groups(spark):
    rows = blobs(200)
    df = spark.createDataFrame(rows, "key long, embedding array<double>")
    labelled, centres = clusters.mini_batch_kmeans(df, 4, "key", batch=50, rounds=40)
    assert centres.shape == (4, 4) and agree(rows, {r.key: r.label for r in labelled.collect()})
    assert clusters.mini_batch_kmeans(df.limit(0), 4, "key")[0].count() == 0


def test_cluster_pipeline_and_dbscan_grid(spark):
    rows = blobs(60, 3)
    df = spark.createDataFrame(rows, "key long, embedding array<double>")
    labelled, report = clusters.cluster_pipeline(df, "key", lambda d: clusters.kmeans(d, 3, "key"))
    assert labelled.count() == report["total"] == 60 and report["clusters"] == 3 and report["silhouette"] > 0.8
    best, scores = clusters.search_dbscan(df, "key", eps_steps=2, samples=(3, 30))
    assert best is not None and all(len(s) == 3 for s in scores)


def test_vectors_of_features(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 2.0]), (2, None), (5, [9.0, 9.0])], "key long, embedding array<float>")
    pooled = features.mean_pool(df.withColumn("g", F.lit("x")), "g").first()
    assert pooled.n == 3 and np.allclose(pooled.pooled, [13 / 3, 13 / 3])
    assert {r.key: r.z for r in features.standardise(df, "key", batch=5).collect()} == {0: [-1.0, 0.0], 1: [1.0, 0.0], 5: [9.0, 9.0]}
    wide = features.select_groups(df, "key", ["statistical"], {}).first().features
    assert wide == [0.0] * 11
    with pytest.raises(ValueError, match="unknown feature groups"):
        features.select_groups(df, "key", ["sound"], {})


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for k, name in enumerate("ab"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {n} {'x' * 40}\n" if n % 7 else "\n" for n in range(k * 1000, k * 1000 + 900)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r.id: r.text for r in readers.text_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = [x.strip() for name in "ab" for x in (tmp_path / f"{name}.txt").read_text().split("\n")[:-1]]
    assert got == {n: x for n, x in enumerate(lines) if x}


def test_load_all_names_bad_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    (tmp_path / "c.csv").write_text("x,y\n5,6\n")
    (tmp_path / "bad.parquet").write_text("no parquet")
    spark.createDataFrame([("7",)], "x string").coalesce(1).write.parquet(f"{tmp_path}/good.parquet")
    (tmp_path / "what.bin").write_text("?")
    rows, failed = readers.load_folder(spark, str(tmp_path))
    assert sorted((r.x, r.y, r.z) for r in rows.fillna("-").collect()) == [("-", "3", "4"), ("1", "2", "-"), ("5", "6", "-"), ("7", "-", "-")]
    assert sorted(p.rsplit("/", 1)[-1] for p, _ in failed) == ["bad.parquet", "what.bin"]


def test_positional_join_needs_equal_length(spark):
    left, right = spark.range(3).withColumnRenamed("id", "n"), spark.range(2).select(F.col("id").alias("n"), F.lit(1).alias("v"))
    assert evaluation.positional_join(right, right.withColumnRenamed("v", "w"), "n").count() == 2
    with pytest.raises(ValueError, match="differ in length"):
        evaluation.positional_join(left, right, "n")


def test_compute_by_default_and_for_no_rows(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "pred int, label int")
    assert evaluation.compute(df).columns == ["accuracy", "exact_match", "f1"]
    assert evaluation.compute(df.limit(0), ["f1", "f1_weighted", "accuracy"]).first().asDict() == {"f1": 0.0, "f1_weighted": 0.0, "accuracy": 0.0}


def test_vectors_come_first_in_the_cascade(spark):
    encode = lambda texts: [[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in texts]
    similar = metric_dedup.vector_similarity(encode, lambda x, y: -1.0)
    assert similar("a cat", "the cats") == 1.0 and similar("a cat", "dog") == 0.0 and similar("", "cat") == 0.0
    assert metric_dedup.vector_similarity(lambda x: 1 / 0, lambda x, y: 0.25)("a", "b") == 0.25
    rows = [(1, 0, "a cat", ""), (1, 1, "many cats", "count"), (1, 2, "dogs", "")]
    df = spark.createDataFrame(rows, "g int, k int, general string, specific string")
    assert sorted(r.general for r in metric_dedup.deduplicate(df, "g", ["k"], encode=encode).collect()) == ["dogs", "many cats"]


def test_adapters(spark):
    class Half:
        def load(self):
            self.ready = True

        def generate(self, prompts):
            if len(prompts) > 1 or "bad" in prompts[0]:
                raise RuntimeError("too much")
            return [x.upper() for x in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, question string").coalesce(1)
    got = {r.id: (r.answer, r.error) for r in models.generate(df, Half).collect()}
    assert got == {1: ("A", None), 2: (None, "too much"), 3: ("", None)}
    own = models.Registry("thing")
    own.register("x", lambda n: n + 1)
    assert own.get("x", n=1) == 2 and models.ADAPTERS.names() == ["call", "echo"]
    with pytest.raises(ValueError, match="registered"):
        own.register("x", int)
    with pytest.raises(KeyError, match="unknown thing"):
        own.get("y")
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 2:
            raise TimeoutError
        return text * 2

    assert models.CallAdapter(flaky, 2, 0).generate(["ab"]) == ["abab"]
    manager = models.BenchmarkManager()
    manager.register(models.Benchmark("b", lambda s: s.createDataFrame([(1, "q", "q"), (2, "r", None)], "n int, question string, answer string"), "n", taxonomy=("answer",)))
    assert manager.names(["answer"]) == ["b"] and manager.names(["none"]) == []
    assert {r.status for r in manager.evaluate(spark, ["b"], models.EchoAdapter).collect()} == {"ok", "skipped"}
    with pytest.raises(KeyError, match="unknown benchmark"):
        manager.load(spark, "c")


def test_registry_copies_and_deletes(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "w.bin").write_text("weights")
    root = f"{tmp_path}/reg"
    assert registry.versions(spark, root).count() == 0
    one = registry.register_version(spark, root, f"{tmp_path}/m", "20260102", description="d", training_epochs=3)
    assert one == "v20260102_001" and (tmp_path / "reg" / "models" / one / "w.bin").read_text() == "weights"
    r = registry.versions(spark, root).first()
    assert (r.version, r.description, r.training_epochs) == (one, "d", 3) and r.model_path.endswith(one)
    assert registry.delete_version(spark, root, one) and not registry.delete_version(spark, root, one)
    assert registry.versions(spark, root).count() == 0 and not (tmp_path / "reg" / "models" / one).exists()
    kept = [registry.save_checkpoint(spark, f"{tmp_path}/ck", f"{tmp_path}/m", e, v, keep=2) for e, v in ((1, 0.5), (2, 0.2), (3, 0.4))]
    assert kept[-1] == [2, 3] and not (tmp_path / "ck" / "epoch_00001").exists() and (tmp_path / "ck" / "best" / "w.bin").exists()


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workdir.shared_dir(Session())


def test_evaluations_need_their_fields(spark):
    fields = ", ".join(f"{f} {'double' if f.endswith(('score', 'confidence')) else 'string'}" for f in scoring.REPLY_FIELDS)
    schema = f"sample_id string, model_name string, model_capability string, timestamp string, reply struct<{', '.join(x.replace(' ', ':', 1) for x in fields.split(', '))}, recommended_metrics:array<struct<general_metric_description:string,specific_metric_description:string>>, information_recap:string>"
    whole = (1.0, 0.5, "r", 2.0, 0.5, "r", "o", [("g", None)], None)
    rows = spark.createDataFrame([("a", "m", "sota", "1", whole), ("a", "m", "sota", "2", (3.0, *whole[1:])), ("b", "m", "weak", "1", (None, *whole[1:]))], schema)
    kept = scoring.evaluations(rows, strict=False)
    assert kept.count() == 2 and kept.first().recommended_metrics[0].specific_metric_description == ""
    assert scoring.as_triples(kept).first().sota.correctness_score == 3.0
    with pytest.raises(Exception, match="a reply lacks correctness_score"):
        scoring.evaluations(rows).collect()


def test_overrides_and_fields():
    defaults = {"weak": {"a": 1, "b": 2}, "sota": {"a": 3}}
    assert scoring.with_overrides(defaults, {"weak": {"b": 5}, "sota": "bad", "other": {}}) == {"weak": {"a": 1, "b": 5}, "sota": {"a": 3}}
    assert cleaning.common_fields(["x", "image"], ("image", "picture")) == ["image"]


def test_results_are_written_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "yes")], "id int, answer string")
    writers.results(df, f"{tmp_path}/out", F.concat_ws(": ", F.col("id").cast("string"), "answer"))
    assert spark.read.text(f"{tmp_path}/out/text").first().value == "1: yes" and spark.read.schema("id int").json(f"{tmp_path}/out/json").first().id == 1
