"""Hierarchical clusters inside each group.

A group with at most ``small`` clusters is finished in one task, by the matrix
of their distances. Above that the work is in rounds over the whole table:

* single linkage: the lightest edge that leaves a cluster is in the minimum
  spanning tree; each round finds it for all clusters, over pairs of blocks, and
  contracts along these edges. The tree's edges are the merges.
* Ward: clusters are centres with sizes. Clusters that are each other's nearest
  merge; they would in any order, as merging others brings no cluster nearer.
* complete and average: the same, on a table of the distances of all pairs of
  clusters, which each round folds; it has n^2 / 2 rows, spread over all tasks.

A cluster is named by its least key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import block_pairs, connected_components, distances, exact, matrix, squares
from tessera.workdir import checkpointed

_MERGE = "grp string, a long, b long, height double, turn int"


def merge_matrix(d: np.ndarray, size: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) by Lance-Williams updates of a matrix (of squares for Ward); new clusters count on from n."""
    n = len(d)
    d, size, name, out = d.astype(float).copy(), size.astype(float).copy(), np.arange(n), []
    np.fill_diagonal(d, np.inf)
    # The nearest of each cluster is kept, so that a merge costs a row, not the matrix.
    near = d.argmin(axis=1) if n else np.zeros(0, dtype=np.int64)
    least = d[np.arange(n), near]
    for step in range(n - 1):
        p = int(np.argmin(least))
        i, j = min(p, int(near[p])), max(p, int(near[p]))
        height = d[i, j]
        out.append((int(min(name[i], name[j])), int(max(name[i], name[j])), float(np.sqrt(height) if linkage == "ward" else height)))
        if linkage == "ward":
            total = size[i] + size[j] + size
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / total
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        elif linkage == "single":
            new = np.minimum(d[i], d[j])
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i], name[i] = size[i] + size[j], n + step
        stale = np.flatnonzero((near == i) | (near == j))
        stale = np.union1d(stale, [i, j])
        near[stale] = d[stale].argmin(axis=1)
        least[stale] = d[stale, near[stale]]
        closer = (new < least) | (new == least) & (i < near) & np.isfinite(new)
        near[closer], least[closer] = i, new[closer]
    return out


def ward_squares(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return distances(x, x) ** 2 * (2 * np.outer(size, size) / np.add.outer(size, size))


def named(merges: list[tuple[int, int, float]], keys: list[int]) -> list[tuple[int, int, float]]:
    """The merges with clusters named by their least key."""
    names, out = list(keys), []
    for p, q, h in merges:
        a, b = sorted((names[p], names[q]))
        out.append((a, b, h))
        names.append(a)
    return out


def _rows(grp: str, merges: list[tuple[int, int, float]], turn: int) -> pd.DataFrame:
    return pd.DataFrame([(grp, a, b, h, turn + k) for k, (a, b, h) in enumerate(merges)], columns=["grp", "a", "b", "height", "turn"]).astype({"grp": str, "a": "int64", "b": "int64", "height": float, "turn": "int32"})


_LAST = 1 << 30  # turns of merges that one task makes come after those of rounds


def finished(clusters: DataFrame, linkage: str) -> DataFrame:
    """The merges of groups (grp, key, vec, size) that are small."""

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        x, size = matrix(frame), frame["size"].to_numpy().astype(float)
        d = ward_squares(x, size) if linkage == "ward" else distances(x, x)
        return _rows(frame["grp"].iloc[0], named(merge_matrix(d, size, linkage), frame["key"].tolist()), _LAST)

    return clusters.groupBy("grp").applyInPandas(f, _MERGE)


_NUMBERS = {"key": "i8", "label": "i8", "size": "f8"}


def _lightest_rows(p: dict, q: dict, ward: bool) -> tuple[np.ndarray, ...]:
    """(of p, i, j, w): near-least pairs that leave their label, for each row of p and of q at least one least pair."""
    weigh = lambda n, m: np.sqrt(2 * (n * m) / (n + m))
    least, parts = np.full(len(q["key"]), np.inf), []
    for at in range(0, len(p["key"]), 256):
        part = slice(at, at + 256)
        d, slack = squares(p["vec"][part], q["vec"])
        if ward:
            factor = weigh(p["size"][part][:, None], q["size"][None, :]) ** 2
            d *= factor
            slack *= float(factor.max())
        d[p["label"][part][:, None] == q["label"][None, :]] = np.inf
        np.minimum(least, d.min(axis=0), out=least)
        near = (d <= d.min(axis=1)[:, None] + 2 * slack) | (d <= least[None, :] + 2 * slack)
        near &= np.isfinite(d)
        i, j = np.nonzero(near)
        w = exact(p["vec"][part], q["vec"], i, j)
        i += at
        parts.append((i, j, w * weigh(p["size"][i], q["size"][j]) if ward else w))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def lightest(clusters: DataFrame, ward: bool, rows: int | None = None) -> DataFrame:
    """(grp, label, w, a, b, to): for each label of each group the least pair (weight, then names) that leaves it, and where it leads."""

    def f(place, left, right) -> pa.Table:
        i, j, w = _lightest_rows(left, right, ward)
        x, y, p, q = left["key"][i], right["key"][j], left["label"][i], right["label"][j]
        a, b = np.minimum(x, y), np.maximum(x, y)
        found = []
        for label, to in ((p, q), (q, p)):
            order = np.lexsort((b, a, w, label))
            first = order[np.append(True, np.diff(label[order]) != 0)] if len(order) else order
            found.append(pa.table({"grp": pa.array([place[0]] * len(first), pa.string()), "label": label[first], "w": w[first], "a": a[first], "b": b[first], "to": to[first]}))
        return pa.concat_tables(found)

    met = block_pairs(clusters.select("grp", "key", "vec", "size", "label"), ["grp"], _NUMBERS, f, "grp string, label long, w double, a long, b long, to long", rows)
    return met.groupBy("grp", "label").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("grp", "label", "e.*")


def _by_size(clusters: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(groups with more clusters than ``small``, the others)."""
    large = checkpointed(clusters.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > small).select("grp"))
    return clusters.join(large, "grp", "left_semi"), clusters.join(large, "grp", "left_anti")


def _tree(points: DataFrame, rows: int | None) -> DataFrame:
    """Merges of single linkage: the edges of each group's minimum spanning tree."""
    state, found, turn = checkpointed(points.withColumn("label", F.col("key"))), None, 0
    while True:
        out = checkpointed(lightest(state, False, rows))
        if out.isEmpty():
            return found if found is not None else _none(points)
        edges = out.select("grp", "a", "b", F.col("w").alias("height"))
        found = checkpointed((edges if found is None else found.select("grp", "a", "b", "height").unionByName(edges)).distinct()).withColumn("turn", F.lit(0))
        turn += 1
        node = lambda c: F.struct("grp", F.col(c).alias("k"))
        names = connected_components(out.select(node("label").alias("a"), node("to").alias("b"))).select(F.col("node.grp").alias("grp"), F.col("node.k").alias("label"), F.col("label.k").alias("new"))
        state = checkpointed(state.join(names, ["grp", "label"], "left").select("grp", "key", "vec", "size", F.coalesce("new", "label").alias("label")))


def _none(points: DataFrame) -> DataFrame:
    return points.select("grp", F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("height"), F.lit(0).alias("turn")).limit(0)


def _mutual(near: DataFrame) -> DataFrame:
    """(grp, a, b, w): pairs that are the least of both their clusters."""
    return near.groupBy("grp", "a", "b", "w").agg(F.count("*").alias("n")).where("n = 2").drop("n")


def _ward(points: DataFrame, small: int, rows: int | None) -> DataFrame:
    state, done, parts, turn = points, [], [], 0
    while True:
        large, rest = _by_size(state, small)
        parts.append(rest)
        if large.isEmpty():
            break
        large = checkpointed(large)
        pairs = checkpointed(_mutual(lightest(large.withColumn("label", F.col("key")), True, rows)))
        done.append(pairs.select("grp", "a", "b", F.col("w").alias("height"), F.lit(turn).alias("turn")))
        turn += 1
        into = pairs.select("grp", F.col("b").alias("key"), F.col("a").alias("new"))
        renamed = large.join(into, ["grp", "key"], "left").select("grp", F.coalesce("new", "key").alias("key"), "vec", "size")
        # Two rows at most meet under a name.
        ends = renamed.groupBy("grp", "key").agg(F.min(F.struct("size", "vec")).alias("x"), F.max(F.struct("size", "vec")).alias("y"), F.count("*").alias("n"))
        mixed = F.zip_with("x.vec", "y.vec", lambda p, q: (p * F.col("x.size") + q * F.col("y.size")) / (F.col("x.size") + F.col("y.size")))
        state = checkpointed(ends.select("grp", "key", F.when(F.col("n") == 1, F.col("x.vec")).otherwise(mixed).alias("vec"), F.when(F.col("n") == 1, F.col("x.size")).otherwise(F.col("x.size") + F.col("y.size")).alias("size")))
    return _union([*done, *[finished(p, "ward") for p in parts]])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pair_table(points: DataFrame, linkage: str, rows: int | None) -> DataFrame:
    """Merges of complete and average linkage from the distances of all pairs of clusters."""

    def f(place, left, right) -> pa.Table:
        found = []
        for at in range(0, len(left["key"]), 256):
            x, y = left["key"][at : at + 256], right["key"]
            i, j = np.nonzero(x[:, None] < y[None, :] if place[1] == place[2] else np.ones((len(x), len(y)), dtype=bool))
            a, b = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
            found.append(pa.table({"grp": pa.array([place[0]] * len(i), pa.string()), "a": a, "b": b, "d": exact(left["vec"][at : at + 256], right["vec"], i, j), "n": np.ones(len(i))}))
        return pa.concat_tables(found)

    pairs = checkpointed(block_pairs(points.withColumn("label", F.col("key")), ["grp"], _NUMBERS, f, "grp string, a long, b long, d double, n double", rows or 1024))
    done, turn = [], 0
    while not pairs.isEmpty():
        both = pairs.select("grp", F.col("a").alias("label"), "a", "b", "d").unionByName(pairs.select("grp", F.col("b").alias("label"), "a", "b", "d"))
        near = both.groupBy("grp", "label").agg(F.min(F.struct(F.col("d").alias("w"), "a", "b")).alias("e")).select("grp", "label", "e.*")
        merged = checkpointed(_mutual(near))
        done.append(merged.select("grp", "a", "b", F.col("w").alias("height"), F.lit(turn).alias("turn")))
        turn += 1
        x, y = merged.select("grp", F.col("b").alias("a"), F.col("a").alias("p")), merged.select("grp", "b", F.col("a").alias("q"))
        moved = pairs.join(x, ["grp", "a"], "left").join(y, ["grp", "b"], "left").select("grp", F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"), "d", "n").where("a <> b")
        one = moved.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d", "n").groupBy("grp", "a", "b")
        gap = F.max("d") if linkage == "complete" else F.sum(F.col("d") * F.col("n")) / F.sum("n")
        pairs = checkpointed(one.agg(gap.alias("d"), F.sum("n").alias("n")))
    return _union(done) if done else _none(points)


def merges(points: DataFrame, linkage: str = "ward", small: int = 1024, rows: int | None = None) -> DataFrame:
    """(grp, a, b, height, turn) of points (grp, key, vec): the merges of each group's clusters a and b."""
    if linkage not in ("ward", "single", "complete", "average"):
        raise ValueError(f"unknown linkage {linkage!r}")
    sized = checkpointed(points.withColumn("size", F.lit(1.0)))
    if linkage == "ward":
        return _ward(sized, small, rows)
    large, rest = _by_size(sized, small)
    if large.isEmpty():
        return finished(rest, linkage)
    big = _tree(large, rows) if linkage == "single" else _pair_table(large, linkage, rows)
    return big.unionByName(finished(rest, linkage))


def labels(points: DataFrame, merged: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """(grp, key, label): k clusters of each group, or those of the merges up to a height; numbered by least member."""
    if k is not None:
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("height").desc(), F.col("turn").desc(), F.col("a").desc(), F.col("b").desc()))
        top = merged.withColumn("rank", rank).where(F.col("rank") < k).select("grp", "a", "b")
        kept = merged.join(top, ["grp", "a", "b"], "left_anti")
    else:
        kept = merged.where(F.col("height") <= height)
    node = lambda c: F.struct(F.col("grp"), F.col(c).alias("k"))
    loops = points.select(node("key").alias("a"), node("key").alias("b"))
    found = checkpointed(connected_components(kept.select(node("a").alias("a"), node("b").alias("b")).unionByName(loops)))
    number = F.row_number().over(Window.partitionBy("grp").orderBy("least")) - 1
    numbers = found.select(F.col("label.grp").alias("grp"), F.col("label.k").alias("least")).distinct().withColumn("label", number)
    return found.select(F.col("node.grp").alias("grp"), F.col("node.k").alias("key"), F.col("label.k").alias("least")).join(numbers, ["grp", "least"]).select("grp", "key", "label")
