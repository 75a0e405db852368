"""Feature caches that go on, embedding stores that call once, and graders that fail."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import graders
from tessera.operators.agents import FatalError
from tessera.operators.embedding import Client, Store
from tessera.operators.graders import Tier, chat_batch
from tessera.sources.cache import FeatureCache


def test_cache_makes_missing_batches_only(spark, tmp_path):
    cache = FeatureCache(spark, str(tmp_path / "c"))
    made = spark.sparkContext.accumulator(0)
    rows = spark.range(100).select(F.col("id"), (F.col("id") / 10).cast("long").alias("batch"))

    def make(df, broken=None):
        def f(frames):
            for frame in frames:
                if broken is not None and (frame["batch"] >= broken).any():
                    raise RuntimeError("breaks off")
                made.add(len(frame))
                yield frame.assign(v=frame["id"] * 2.0)

        return df.mapInPandas(f, "id long, batch long, v double")

    with pytest.raises(Exception, match="breaks off"):
        cache.fill("x", rows, lambda df: make(df, 6), jobs=5)
    assert sorted(r.batch for r in cache.manifest("x").collect()) == list(range(6))
    assert cache.read("x").count() == 60
    before = made.value
    assert cache.fill("x", rows, make, jobs=2) == 2
    assert made.value - before == 40
    assert cache.fill("x", rows, make) == 0
    assert {r.batch: r.rows for r in cache.manifest("x").collect()} == {k: 10 for k in range(10)}
    cache.write("x", spark.createDataFrame([(3, 3, -1.0)], "id long, batch long, v double"))  # one batch again
    got = cache.read("x")
    assert got.count() == 91 and got.where("batch = 3").collect()[0].v == -1.0
    assert cache.delete("x") and not cache.delete("x")
    with pytest.raises(FileNotFoundError):
        cache.read("x")
    with pytest.raises(ValueError, match="name"):
        cache.manifest("../x")


def test_cache_knows_batches_without_rows(spark, tmp_path):
    cache = FeatureCache(spark, str(tmp_path / "c"))
    rows = spark.range(30).select(F.col("id"), (F.col("id") / 10).cast("long").alias("batch"))
    assert cache.fill("x", rows, lambda df: df.where("batch <> 1"), jobs=1) == 1
    assert {r.batch: r.rows for r in cache.manifest("x").collect()} == {0: 10, 1: 0, 2: 10}
    assert cache.fill("x", rows, lambda df: df) == 0


def test_client_batches_retries_and_order():
    calls, now, most, lock = [], [0], [0], threading.Lock()

    def encode(texts):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            calls.append(len(texts))
            first = calls.count(len(texts)) == 1
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        if len(texts) == 5 and first:
            raise TimeoutError("slow")
        return [[float(x)] for x in texts]

    found = list(Client(encode, "m", batch=10, in_flight=3, pause=0.001).calls([str(k) for k in range(95)]))
    assert [v for v, _ in found] == [[float(k)] for k in range(95)] and all(e is None for _, e in found)
    assert calls.count(10) == 9 and calls.count(5) == 2 and most[0] <= 3
    tries = []

    def fails(texts):
        tries.append(1)
        raise FatalError("no key") if texts == ["x"] else ConnectionError("down")

    assert Client(fails, "m", retries=3, pause=0.001).call(["x"]) == ([None], "FatalError: no key") and len(tries) == 1
    assert Client(fails, "m", retries=3, pause=0.001).call(["y"])[1] == "ConnectionError: down" and len(tries) == 5
    assert "2 texts" in Client(lambda texts: [[1.0]], "m", retries=0).call(["a", "b"])[1]


def test_store_asks_once_for_each_text(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def encode(texts):
        asked.add(len(texts))
        if "bad" in texts:
            raise ConnectionError("down")
        return [[float(len(x))] for x in texts]

    store, client = Store(spark, str(tmp_path / "s")), Client(encode, "a/b", batch=1, retries=0)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["one", "three", "one", None, "", "bad"])], "id long, text string")
    got = {r.id: (r.embedding, r.error) for r in store.embed(rows, "text", client, tasks=2).collect()}
    assert got == {0: ([3.0], None), 1: ([5.0], None), 2: ([3.0], None), 3: (None, None), 4: ([0.0], None), 5: (None, "ConnectionError: down")}
    assert asked.value == 4
    again = store.embed(rows.union(spark.createDataFrame([(9, "seven")], rows.schema)), "text", client)
    assert {r.id: r.embedding for r in again.collect()}[9] == [5.0]
    assert asked.value == 6  # the new one, and the one that failed
    assert again.columns == ["id", "text", "embedding", "error"]
    assert store.embed(rows, "text", Client(lambda texts: [[1.0]] * len(texts), "other")).where("embedding[0] = 1").count() == 5


def model_class():
    """A class of its own scope, which workers get by value."""

    class Model:
        def __init__(self, mode="ok"):
            self.mode, self.sizes = mode, []

        def load(self):
            if self.mode == "unloadable":
                raise OSError("no weights")

        def generate(self, prompts):
            self.sizes.append(len(prompts))
            if any("fail" in p for p in prompts):
                raise TimeoutError(self.mode)
            if self.mode == "short" and len(prompts) > 1:
                return prompts[:1]
            return ['{"correctness_score": 8, "training_quality_score": 6.5}' for _ in prompts]

    return Model


Model = model_class()


def test_chat_batch():
    model = Model()
    got = chat_batch(model, ["a", "b", "fail", "c", "d"], False, 3, 2)
    assert [e for _, e in got] == [None, None, "TimeoutError: ok", None, None]
    assert model.sizes == [3, 1, 1, 1, 2]
    assert [r for r, _ in chat_batch(Model("short"), ["a", "b"], False, 2, 1)] == [r for r, _ in chat_batch(Model(), ["a", "b"], True, 2, 2)]
    assert chat_batch(model, [], True, 2, 2) == []


def test_tiers_that_fail_give_fallback_rows(spark):
    samples = spark.createDataFrame([("s1", "a"), ("s2", "fail"), ("s3", None)], "id string, prompt string").na.fill("")
    tiers = [Tier("weak", "local", Model), Tier("normal", "api", Model), Tier("sota", "hub", lambda: Model("unloadable")), Tier("x", "other", Model)]
    rows = {(r.sample_id, r.cap): r for r in graders.evaluate(samples, tiers, "id", tasks=2).collect()}
    assert len(rows) == 12
    assert {k for k, r in rows.items() if not r.is_fallback} == {(s, c) for s in ("s1", "s3") for c in ("weak", "normal")}
    good, lost = rows["s1", "weak"], rows["s1", "sota"]
    assert (good.corr, good.corr_conf, good.train, good.n_metrics, good.error) == (8.0, 0.5, 6.5, 0, None)
    assert (lost.corr, lost.corr_conf, lost.train, lost.error) == (5.0, 0.5, 5.0, "OSError: no weights")
    assert rows["s2", "x"].error.startswith("ValueError")
    best = graders.evaluate(samples, tiers, "id", all_tiers=False).collect()
    assert {r.cap for r in best} == {"sota"} and len(best) == 3


def test_replies_shuffle_no_prompts_where_partitions_are_enough(spark, capsys):
    samples = spark.range(0, 40, 1, 4).selectExpr("id AS sample_id", "cast(id AS string) AS prompt")
    tiers = [graders.Tier(c, "radio", list) for c in ("weak", "sota")]
    found = graders.replies(samples, tiers, tasks=4)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert found.count() == 80 and graders.replies(samples, tiers[:1], all_tiers=False).count() == 0
