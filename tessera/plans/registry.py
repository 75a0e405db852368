"""Registered queries: each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.views import sql_view, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The driver's tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register f(inputs) as a query. ``{v_name}`` in the SQL stands for a derived view."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql_view(sql)
        return f

    return register
