import pytest
from pyspark.sql import functions as F

from tessera.sources import hub
from tessera.streaming import streams


@pytest.fixture
def dataset(spark, tmp_path):
    """Two configs: one of named shards of several row groups, one of folders; and JSON lines."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path / "set"
    (root / "default").mkdir(parents=True)
    for k in range(3):
        rows = pa.table({"id": range(k * 100, k * 100 + 100), "text": [f"t{n}" for n in range(100)]})
        pq.write_table(rows, root / "default" / f"train-0000{k}-of-00003.parquet", row_group_size=40)
    pq.write_table(pa.table({"id": [900, 901], "text": ["a", None]}), root / "default" / "test.parquet")
    spark.range(50).select("id", F.lit("x").alias("text")).repartition(3).write.parquet(f"{root}/small/train")
    (root / "lines").mkdir()
    (root / "lines" / "dev.jsonl").write_text('{"id": 1, "text": "p"}\n{"id": 2, "text": "q"}\n')
    return str(root)


def test_splits_configs_and_columns(spark, dataset):
    whole = hub.load(spark, dataset)
    assert whole.columns == ["id", "text", "split"]
    assert {r.split: r.n for r in whole.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 300, "test": 2}
    assert hub.load(spark, dataset, "test").orderBy("id").collect()[1] == (901, None, "test")
    assert hub.load(spark, dataset, "train", "small").count() == 50
    assert hub.load(spark, dataset, config="lines").orderBy("id").collect() == [(1, "p", "dev"), (2, "q", "dev")]
    assert hub.load(spark, dataset, "test", schema="id long").count() == 2
    assert hub.load(spark, dataset, "test", schema="id long, more string").select("more").distinct().collect() == [(None,)]
    assert hub.configs(dataset) == ["default", "lines", "small"]


def test_filter_on_split_leaves_other_shards_unread(spark, dataset):
    whole = hub.load(spark, dataset)
    assert whole.rdd.getNumPartitions() == 10  # three shards of three row groups, and one of one
    one = whole.where("split = 'test'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 2
    assert whole.where("split IN ('test', 'none') AND id > 900").collect() == [(901, None, "test")]
    assert whole.where("split = 'none'").count() == 0
    assert whole.where("id = 5").count() == 1


def test_what_is_missing_is_named(spark, dataset):
    with pytest.warns(UserWarning, match="isn't among"), pytest.raises(hub.HubError, match=r"splits: \['test', 'train'\]"):
        hub.chosen(dataset, None, "dev")
    with pytest.raises(Exception, match="no split 'dev'"):
        hub.load(spark, dataset, "dev").collect()
    with pytest.raises(hub.HubError, match="configs"):
        hub.shards(dataset, "other")


def test_stream_takes_each_shard_once(spark, dataset, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    streams.run_to_parquet(hub.load(spark, dataset, "train", stream=True), out, mark)
    assert spark.read.parquet(out).count() == 300
    pq.write_table(pa.table({"id": [5000], "text": ["new"]}), f"{dataset}/default/train-00009-of-00010.parquet")
    streams.run_to_parquet(hub.load(spark, dataset, "train", stream=True), out, mark)
    rows = spark.read.parquet(out)
    assert rows.count() == 301 and rows.select("id").distinct().count() == 301
