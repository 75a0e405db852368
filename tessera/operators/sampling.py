"""Sampling, balancing and splitting with a seeded hash in place of a random generator.

The order of rows is that of md5(seed, key): equal on every engine and cluster
size. Exact counts are kept; ranks are taken inside a class, which is cut into
hash bins first, so that no class has to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BIN_DIGITS = 3  # 4096 bins of the md5 order


def chance(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_rank(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """Adds ``rank`` (from 1) in the seeded order within the group, and ``size`` of the group.

    Ranks are local ranks in a hash bin plus the sizes of the bins before it;
    the table of bins has at most 4096 rows for each group.
    """
    marked = df.withColumn("_chance", chance(F.col(key), seed)).withColumn("_bin", F.substring("_chance", 1, _BIN_DIGITS))
    by = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    keys = [f"_g{k}" for k in range(len(group))]
    bins = marked.groupBy(*by, F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = bins.withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "size": F.sum("_n").over(whole)}).drop("_n")
    condition = F.col("_bin") == F.col("_b")
    for k, g in enumerate(group):
        condition &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    local = F.row_number().over(Window.partitionBy(*group, "_bin").orderBy("_chance", key))
    ranked = marked.withColumn("_local", local).join(placed, condition)
    return ranked.withColumn("rank", F.col("_local") + F.col("_before")).drop("_chance", "_bin", "_b", "_local", "_before", *keys)


def sample_each(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, size) rows of each group."""
    return hash_rank(df, [group], key, seed).where(F.col("rank") <= n)


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest label has."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return hash_rank(df, [label], key, seed).join(F.broadcast(least), F.col("rank") <= F.col("_least")).drop("_least")


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """All rows, and seeded repeats of each label up to the most frequent one; ``copy`` is 0 for originals."""
    most = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.max("n").alias("_most"))
    ranked = hash_rank(df, [label], key, seed).join(F.broadcast(most), F.col("rank") <= F.col("_most"))
    # Row r of a group of s stands at r, r + s, r + 2s, ... of the m places.
    times = F.floor((F.col("_most") - F.col("rank")) / F.col("size")).cast("int")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).drop("_most")


def split(df: DataFrame, key: str, ratios: tuple[float, float] = (0.8, 0.1), stratum: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split``: train, val, test by seeded order; counts are cut off and the rest is test.

    With a stratum each of its values (null is one) is split by itself.
    """
    ranked = hash_rank(df.withColumn("_all", F.lit(0)), [stratum or "_all"], key, seed)
    return ranked.withColumn("split", _slice(ratios)).drop("_all")


def _slice(ratios: tuple[float, float]) -> Column:
    train, val = (F.floor(F.col("size") * F.lit(r)) for r in ratios)
    return F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")


def ordered_split(df: DataFrame, ordinal: str, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Adds ``split`` by position; ``ordinal`` is dense from 0, so no ranking is needed."""
    total = df.agg(F.count("*").alias("size"))
    placed = df.withColumn("rank", F.col(ordinal) + 1).join(F.broadcast(total), F.lit(True))
    return placed.withColumn("split", _slice(ratios)).drop("rank", "size")
