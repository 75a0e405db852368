"""Mixing sources to target weights by fitting each source's word budget.

Documents are counted by exact length for each source. A source's target is
met by whole copies of it plus a remainder; most of the remainder is spread
over the lengths in proportion, the last part is fitted by a bounded knapsack
over the lengths, from below and, by what to leave out, from above, whichever
comes nearer; each length's documents are then chosen by a seeded hash.

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, after all others; repeated rows count and are chosen one by
one, in an order that the hash leaves open only between equal rows; with no
words at all every target is 0; an empty table gives no rows; other columns,
whatever their names, are ignored; a text of any length is one document, which
is taken or not as the nearer fit says.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.linededup import text_hash
from tessera.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
_BINS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: tuple[str, ...], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with ``upto``-style columns: for each (name, expression) of ``sums`` the sum over all rows before, in this order.

    Ranges of the order are summed apart and get the sum of the ranges before
    them, so no task holds more than a range.
    """
    ranged = written(df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), **{f"_own_{n}": F.expr(x) for n, x in sums.items()}}), label)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_own_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select(F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_at"))
    return joined.select(*df.columns, *[(F.coalesce(F.sum(f"_own_{n}").over(own), F.lit(0)) + F.col(f"_before_{n}")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_copies: int = 3) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size): one row for each source.

    Water level: a source gets level * weight, at most ``most_copies`` times
    its size, where the level makes all targets add up to ``share`` of all
    sizes. That is where repeated resharing of the excess ends.
    """
    ranked = running(sizes.select("key", "source_size", F.col("source").isNull().alias("last"), "source"), ("last", "source"), {"at": "1"}, "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    capped = ranked.select("key", "source_size", "at", weight.alias("w"), (F.lit(most_copies) * F.col("source_size")).alias("cap"))
    levels = running(capped.withColumn("ratio", F.col("cap") / F.col("w")), ("ratio", "at"), {"cap_before": "cap", "w_before": "w"}, "levels")
    whole = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    level = F.greatest(F.lit(0.0), F.lit(whole["words"] * share) - F.col("cap_before")) / (F.lit(whole["w"]) - F.col("w_before"))
    water = levels.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("ratio", "at", "level"))["level"].alias("level")).first()["level"]
    reached = F.col("cap") if water is None else F.least(F.col("cap"), F.lit(float(water)) * F.col("w"))
    return levels.select("key", "source_size", reached.cast("double").alias("target"))


def fit_below(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, window: int) -> np.ndarray:
    """How many documents of each length to take, with as many words as can be found up to ``budget``.

    Longest first, each length gets its share of ``budget - window``. What is
    then left over ``window`` goes to the longest that fit, and a bounded
    subset-sum over the lengths that are left fits the rest.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    share, wanted, spent = max(0, budget - window) / total, 0.0, 0
    longest = np.argsort(-lengths, kind="stable")
    for k in longest:
        length, there = int(lengths[k]), int(counts[k])
        if length:
            wanted += share * length * there
            taken[k] = min(there, max(0, int((wanted - spent) // length)))
            spent += int(taken[k]) * length
    rest = budget - spent
    for k in longest:
        length = int(lengths[k])
        if rest <= window:
            break
        if 0 < length <= rest:
            more = min(int(counts[k] - taken[k]), rest // length, (rest - window) // length + 1)
            taken[k] += more
            rest -= more * length
    order = np.random.default_rng(seed).permutation(len(lengths))
    items: list[tuple[int, int]] = []
    for k in order:
        length, left = int(lengths[k]), int(counts[k] - taken[k])
        if 0 < length <= rest:
            left, bundle = min(left, rest // length), 1
            while left > 0:
                items.append((int(k), min(bundle, left)))
                left, bundle = left - bundle, bundle * 2
    if not items:
        return taken
    reach, mask, via = 1, (1 << (rest + 1)) - 1, np.full(rest + 1, -1, dtype=np.int32)
    n_bytes = rest // 8 + 1
    for at, (k, bundle) in enumerate(items):
        new = (reach << (int(lengths[k]) * bundle)) & mask & ~reach
        if new:
            via[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(n_bytes, "little"), np.uint8), bitorder="little"))] = at
            reach |= new
            if reach >> rest & 1:
                break
    value = reach.bit_length() - 1
    while value > 0:
        k, bundle = items[via[value]]
        taken[k] += bundle
        value -= int(lengths[k]) * bundle
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, window: int, most: int = 1) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to ``budget`` as is found.

    From above as well as from below: what to leave out is fitted up to the
    words over the budget. If no document taken once gives the budget, up to
    ``most`` copies of each are tried. The lower of two equally near fits stays.
    """
    tries = []
    for copies in range(1, most + 1):
        there = counts * copies
        over = int((lengths * there).sum()) - budget
        tries.append(fit_below(lengths, there, budget, seed, window))
        if over > 0 and int((tries[-1] * lengths).sum()) != budget:
            tries.append(there - fit_below(lengths, there, over, seed, window))
        best = min(tries, key=lambda x: abs(int((x * lengths).sum()) - budget))
        if int((best * lengths).sum()) == budget:
            break
    return best


def mix(docs: DataFrame, seed: int = 17, window: int = 20_000, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_copies: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, version, size, source_size, target, times): how often the mix takes each document.

    ``version`` is the text's hash, so that (doc, version) names a row.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    rows = written(
        docs.select(
            F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("version"), source.alias("source"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"), n_words(F.col(text_col)).alias("size")
        ).withColumns({"chance": F.xxhash64(F.lit(seed), "doc", "version")}),
        "sizes",
    )
    lengths = written(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = source_targets(lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most_copies)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        part = part.sort_values("size", ignore_index=True)
        whole = min(most_copies, int(target // size)) if size else 0
        there = part["n"].to_numpy()
        extra = fit_counts(part["size"].to_numpy(), there, round(target - whole * size), seed, window, most_copies - whole) if size and whole < most_copies else 0 * there
        return part.assign(whole=whole + extra // np.maximum(1, there), extra=extra % np.maximum(1, there))[["key", "size", "source_size", "target", "whole", "extra"]]

    fitted = written(lengths.join(targets, "key").groupBy("key").applyInPandas(fit, "key string, size long, source_size long, target double, whole long, extra long"), "fitted")
    binned = rows.withColumn("bin", F.shiftrightunsigned("chance", 64 - _BINS).cast("int"))
    by_bin = binned.groupBy("key", "size", "bin").agg(F.count("*").alias("in_bin"))
    upto = F.sum("in_bin").over(Window.partitionBy("key", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    cuts = by_bin.withColumn("upto", upto).join(fitted, ["key", "size"]).withColumn("first", F.greatest(F.lit(0), F.least(F.col("in_bin"), F.col("extra") - F.col("upto") + F.col("in_bin"))))
    joined = binned.join(cuts, ["key", "size", "bin"])
    settled = joined.where((F.col("first") == 0) | (F.col("first") == F.col("in_bin"))).withColumn("more", (F.col("first") > 0).cast("int"))
    split = joined.where((F.col("first") > 0) & (F.col("first") < F.col("in_bin")))
    nth = F.row_number().over(Window.partitionBy("key", "size", "bin").orderBy("chance", F.col("doc").asc_nulls_last(), "version"))
    chosen = settled.unionByName(split.withColumn("more", (nth <= F.col("first")).cast("int")))
    return chosen.select("doc", "version", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("times"))
