import pytest

from tessera.plans import catalog
from tests.duck import rows_of, same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    found = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(found, rows_of(ORACLES[name], sf))
    else:
        assert found.count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cluster_documents_is_whole_beyond_the_size_of_a_part(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(103_000).select(F.col("id").alias("c_custkey"), F.when(F.col("id") < 500, "few").otherwise("many").alias("c_mktsegment"))
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    found = {r.cluster_id: r for r in QUERIES["cluster_documents"](spark, str(tmp_path)).collect()}
    assert {k: r["size"] for k, r in found.items()} == {"few": 500, "many": 102_500}
    assert found["many"].samples == ",".join(str(k) for k in range(500, 103_000))
