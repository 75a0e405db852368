"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import read_table, remove_table, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): one label for each component.

    Each round maps every node to the least of itself and its neighbours, in an
    order drawn anew by hash, and replaces the edges by those between different
    images. A star is soon gone and a chain shrinks by a factor each round,
    however its nodes are named. Each round is a written table; nothing but
    whether edges are left reaches the driver. A null in an edge drops it, a
    loop says nothing, repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    tables: dict[str, str] = {}

    def replaced(name: str, df: DataFrame) -> DataFrame:
        """Write the next form of a table; the one before goes."""
        path = write_table(df, name)
        if name in tables:
            remove_table(spark, tables[name])
        tables[name] = path
        return read_table(df, path)

    edges = replaced("edges", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    labels, turn = None, 0
    while True:
        turn += 1
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        images = replaced("images", both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), F.col("m"))["v"].alias("label")))
        later = images.select(F.col("node").alias("n"), F.col("label").alias("l"))
        # A table of its own from the first round on, for images are replaced.
        named = images if labels is None else labels.join(later, F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label"))
        labels = replaced("labels", named)
        left = images.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = images.select(F.col("node").alias("b"), F.col("label").alias("y"))
        mapped = edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = replaced("edges", mapped.where(F.col("a") != F.col("b")).distinct())
        if edges.isEmpty():
            for name in ("edges", "images"):
                remove_table(spark, tables[name])
            return labels
