"""The driver's tables in DuckDB, and comparison of rows regardless of their order."""

import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or type(value).__name__ in ("NAType", "NaTType"):
        return "NULL"
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"
    return str(list(value)) if hasattr(value, "__len__") and not isinstance(value, str) else str(value)


def same(spark_df, duck_df):
    a = spark_df.toPandas()
    columns = sorted(a.columns)
    assert columns == sorted(duck_df.columns)
    table = lambda d: sorted(tuple(plain(v) for v in row) for row in d[columns].itertuples(index=False))
    assert table(a) == table(duck_df)
