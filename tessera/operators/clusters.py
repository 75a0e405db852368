"""Clustering of vectors and measures of its quality.

Distances are Euclidean and exact; all-pairs work runs over blocks. In the
measures noise (-1) is a cluster like the others; ``without_noise`` takes it out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.operators.features import mean_pool
from tessera.operators import linkage as hierarchy
from tessera.operators.density import dbscan, eps_range, k_distance, neighbours, search_dbscan  # noqa: F401
from tessera.operators.graph import block_pairs, distances, matrix, precise
from tessera.sources.cache import FeatureCache
from tessera.workdir import checkpointed, ranked


def without_noise(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != -1)


def sizes(df: DataFrame, label: str = "label") -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("size"))
    return n.join(F.broadcast(df.agg(F.count("*").alias("total"))), F.lit(True)).select(label, "size", (F.col("size") * 100.0 / F.col("total")).alias("percentage"))


def kmeans(df: DataFrame, k: int, key: str, vector: str = "embedding", seed: int = 42, iterations: int = 300) -> DataFrame:
    """(key, label) by k-means."""
    points = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(points)
    return model.transform(points).select(key, F.col("prediction").alias("label"))


_NUMBERS = {"key": "i8", "lab": "i8"}


def _cluster_sums(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, other, total, n): summed distance of every point to every cluster, itself left out."""

    def table(own, sums, others, counts) -> pa.Table:
        n, c = sums.shape
        return pa.table({"key": np.repeat(own["key"], c), "label": np.repeat(own["lab"], c), "other": np.tile(others, n), "total": sums.ravel(), "n": np.tile(counts, n)})

    def f(place, left, right) -> pa.Table:
        p, q = ({c: v[np.argsort(b["lab"], kind="stable")] for c, v in b.items()} for b in (left, right))
        (rows, _, m), (columns, first, n) = (np.unique(b["lab"], return_index=True, return_counts=True) for b in (p, q))
        sums, back = np.zeros((len(p["key"]), len(columns))), np.zeros((len(rows), len(q["key"])))
        for at in range(0, len(sums), 256):
            part = slice(at, at + 256)
            d = precise(p["vec"][part], q["vec"])
            sums[part] = np.add.reduceat(d, first, axis=1)
            here, start = np.unique(p["lab"][part], return_index=True)
            back[np.searchsorted(rows, here)] += np.add.reduceat(d, start, axis=0)
        found = table(p, sums, columns, n)
        return found if place[0] == place[1] else pa.concat_tables([found, table(q, back.T, rows, m)])

    points = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"), F.col(label).cast("long").alias("lab"))
    parts = block_pairs(points, [], _NUMBERS, f, "key long, label long, other long, total double, n long")
    return parts.groupBy("key", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette_rows(df: DataFrame, key: str, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, s): silhouette of every point; 0 in clusters of one point."""
    sums = _cluster_sums(df, key, vector, label)
    own = F.max(F.when(F.col("label") == F.col("other"), F.struct(F.col("total").alias("t"), F.col("n").alias("n"))))
    near = F.min(F.when(F.col("label") != F.col("other"), F.col("total") / F.col("n")))
    rows = sums.groupBy("key").agg(own.alias("own"), near.alias("b")).withColumn("a", F.try_divide(F.col("own.t"), F.col("own.n") - 1))
    s = F.when(F.col("own.n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return rows.select("key", F.coalesce(s, F.lit(0.0)).alias("s"))


def silhouette(df: DataFrame, key: str, vector: str = "embedding", label: str = "label") -> DataFrame:
    return silhouette_rows(df, key, vector, label).agg(F.avg("s").alias("silhouette"))


def _spread(df: DataFrame, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(points with their cluster's centre), (label, n, centre)."""
    centres = mean_pool(df.select(F.col(label).alias("l"), vector), "l", vector).withColumnRenamed("pooled", "centre")
    return df.select(F.col(label).alias("l"), F.col(vector).alias("v")).join(centres, "l"), centres


def calinski_harabasz(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    points, centres = _spread(df, vector, label)
    within = points.agg(F.sum(F.pow(a.euclidean(F.col("v"), F.col("centre")), 2)).alias("w"), F.count("*").alias("n"), F.countDistinct("l").alias("k"))
    overall = mean_pool(df.select(F.lit(0).alias("g"), vector), "g", vector).select(F.col("pooled").alias("middle"))
    between = centres.join(F.broadcast(overall), F.lit(True)).agg(F.sum(F.col("n") * F.pow(a.euclidean(F.col("centre"), F.col("middle")), 2)).alias("b"))
    return within.join(F.broadcast(between), F.lit(True)).select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def davies_bouldin(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to centre distance; clusters are few."""
    points, _ = _spread(df, vector, label)
    spread = points.groupBy("l").agg(F.avg(a.euclidean(F.col("v"), F.col("centre"))).alias("s"), F.first("centre").alias("centre"))
    x, y = spread.alias("x"), spread.alias("y")
    pairs = x.join(y, F.col("x.l") != F.col("y.l")).select(F.col("x.l").alias("l"), ((F.col("x.s") + F.col("y.s")) / a.euclidean(F.col("x.centre"), F.col("y.centre"))).alias("r"))
    return pairs.groupBy("l").agg(F.max("r").alias("r")).agg(F.avg("r").alias("score"))


def choose_k(df: DataFrame, key: str, low: int, high: int, vector: str = "embedding", seed: int = 42, most: int = 10_000) -> tuple[int, list[tuple[int, float]]]:
    """The k of the best 0.7 silhouette + 0.3 CH / 10000 over a seeded sample; the first among equals."""
    sample = checkpointed(df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most).select(key, vector))
    n, scores = sample.count(), []
    for k in range(low, min(high, n // 2) + 1):
        labelled = checkpointed(sample.join(kmeans(sample, k, key, vector, seed), key))
        if labelled.select("label").distinct().count() > 1:
            s, ch = silhouette(labelled, key, vector).first()[0], calinski_harabasz(labelled, vector).first()[0]
            scores.append((k, 0.7 * s + 0.3 * ch / 10_000))
    return (max(scores, key=lambda x: (x[1], -x[0]))[0] if scores else low), scores


def dendrogram(x: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) of rows that one task holds; new clusters count on from n."""
    size = np.ones(len(x))
    return hierarchy.merge_matrix(hierarchy.ward_squares(x, size) if linkage == "ward" else distances(x, x), size, linkage)


def cut(merges: list[tuple[int, int, float]], n: int, k: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels from a dendrogram: k clusters, or merges up to a height; labels by first member."""
    parent = list(range(2 * n))
    done = merges[: n - k] if k is not None else [m for m in merges if m[2] <= height]
    for step, (p, q, _) in enumerate(merges):
        if step < len(done):
            parent[p] = parent[q] = n + step

    def root(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    _, first, label = np.unique([root(v) for v in range(n)], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def agglomerative(df: DataFrame, group: str, key: str, k: int | None = None, height: float | None = None, linkage: str = "ward", vector: str = "embedding", small: int = 1024) -> DataFrame:
    """(grp, key, label): hierarchical clusters inside each group, k of them or those of the merges up to a height.

    Groups of over ``small`` points are merged in rounds over the whole table,
    see ``linkage``; no task holds such a group or its distances.
    """
    points = df.where(F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    points = checkpointed(points)
    return hierarchy.labels(points, checkpointed(hierarchy.merges(points, linkage, small)), k, height)


def bisecting(df: DataFrame, k: int, key: str, vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(key, label) by bisecting k-means, for tables whose hierarchy is too large to merge upward."""
    points = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(points).transform(points).select(key, F.col("prediction").alias("label"))


def _silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette from a distance matrix."""
    k = int(labels.max()) + 1
    counts = np.bincount(labels, minlength=k)
    sums = np.stack([d[:, labels == c].sum(axis=1) for c in range(k)], axis=1)
    each = np.arange(len(labels))
    own = counts[labels]
    inner = sums[each, labels] / np.maximum(1, own - 1)
    means = sums / counts
    means[each, labels] = np.inf
    outer = means.min(axis=1)
    return float(np.where(own > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0).mean())


def _variance_ratio(x: np.ndarray, labels: np.ndarray) -> float:
    k, n = int(labels.max()) + 1, len(x)
    centres = np.stack([x[labels == c].mean(axis=0) for c in range(k)])
    within = float(((x - centres[labels]) ** 2).sum())
    between = float((np.bincount(labels) * ((centres - x.mean(axis=0)) ** 2).sum(axis=1)).sum())
    return between / (k - 1) / (within / (n - k)) if within and n > k else 1.0


def best_cut(x: np.ndarray, low: int = 5, high: int = 20, linkage: str = "ward", most: int = 3000) -> tuple[int, np.ndarray, list[tuple[int, float]]]:
    """(k, labels, scores): the cut of one dendrogram with the best 0.7 silhouette + 0.3 CH / 10000, the first among equals.

    Silhouettes are those of at most the first ``most`` rows.
    """
    merges, scores, found = dendrogram(x, linkage), [], {}
    part = slice(0, most)
    d = distances(x[part], x[part])
    for k in range(low, min(high, len(x) // 2) + 1):
        found[k] = cut(merges, len(x), k)
        seen = np.unique(found[k][part], return_inverse=True)[1]
        if seen.max(initial=0) > 0:
            scores.append((k, 0.7 * _silhouette(d, seen) + 0.3 * _variance_ratio(x, found[k]) / 10_000))
    best = max(scores, key=lambda s: (s[1], -s[0]))[0] if scores else min(low, max(1, len(x)))
    return best, found.get(best, cut(merges, len(x), best)), scores


def hierarchical(df: DataFrame, key: str, low: int = 5, high: int = 20, linkage: str = "ward", vector: str = "embedding", seed: int = 42, most: int = 5000) -> tuple[DataFrame, int, list[tuple[int, float]]]:
    """((key, label), k, scores): hierarchical clusters with k chosen over the cuts of one dendrogram.

    The dendrogram is made of at most ``most`` rows by seeded hash, on the
    driver (``most`` squared distances); every other row goes to the cluster of
    the nearest centre of theirs.
    """
    points = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vec"))
    held = points.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(most).toPandas().sort_values("key", ignore_index=True)
    if not len(held):
        return points.select("key", F.lit(0).alias("label")), 0, []
    x = matrix(held)
    k, labels, scores = best_cut(x, low, high, linkage)
    known = dict(zip(held["key"].tolist(), labels.tolist(), strict=True))
    centres = np.stack([x[labels == c].mean(axis=0) for c in range(int(labels.max()) + 1)])
    shared = df.sparkSession.sparkContext.broadcast((known, centres))

    def f(frames):
        own, middle = shared.value
        for frame in frames:
            if len(frame):
                near = distances(matrix(frame), middle).argmin(axis=1)
                yield pd.DataFrame({"key": frame["key"], "label": [own.get(i, c) for i, c in zip(frame["key"].tolist(), near.tolist(), strict=True)]})

    return points.mapInPandas(f, "key long, label int"), k, scores


def mini_batch_kmeans(df: DataFrame, k: int, key: str, vector: str = "embedding", seed: int = 42, batch: int = 1000, rounds: int = 100, starts: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((key, label), centres) by mini-batch k-means: each round moves centres by one drawn batch.

    The driver holds ``k`` centres and batches of ``batch`` rows; all batches
    are drawn at once, by seeded hash. Of ``starts`` starts the one with the least
    distance on the last batches stays.
    """
    points = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vec"))
    drawn = points.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(batch * 20).toPandas()
    x = matrix(drawn) if len(drawn) else np.zeros((0, 1))
    best: tuple[float, np.ndarray] = (np.inf, x[:k])
    for turn in range(starts if len(x) > k else 0):
        rng = np.random.default_rng(seed + turn)
        centres, weight = x[rng.choice(len(x), 1)], np.zeros(k)
        while len(centres) < k:  # far rows start further centres
            gap = distances(x, centres).min(axis=1) ** 2
            centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() else x[rng.integers(len(x))]])
        for _ in range(rounds):
            part = x[rng.choice(len(x), min(batch, len(x)), replace=False)]
            near = distances(part, centres).argmin(axis=1)
            hits = np.bincount(near, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, part)
            weight += hits
            moved = hits > 0
            centres[moved] += (sums[moved] - hits[moved, None] * centres[moved]) / weight[moved, None]
        cost = float((distances(x, centres).min(axis=1) ** 2).mean())
        best = min(best, (cost, centres), key=lambda b: b[0])
    shared = df.sparkSession.sparkContext.broadcast(best[1])

    def f(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"key": frame["key"], "label": distances(matrix(frame), shared.value).argmin(axis=1).astype("int32")})

    return points.mapInPandas(f, f"key {points.schema['key'].dataType.simpleString()}, label int"), best[1]


def cluster_pipeline(features: DataFrame, key: str, fit, vector: str = "embedding") -> tuple[DataFrame, dict]:
    """Cluster checkpointed features with ``fit(df)`` and measure the result: (labelled rows, measures)."""
    held = checkpointed(features.select(key, vector))
    labels = fit(held)
    labelled = checkpointed(held.join(labels.withColumnRenamed(labels.columns[0], "_k"), F.col(key) == F.col("_k")).drop("_k"))
    report = {"total": labelled.count(), "clusters": labelled.select("label").distinct().count()}
    if report["clusters"] > 1:
        report |= {"silhouette": silhouette(labelled, key, vector).first()[0], "calinski_harabasz": calinski_harabasz(labelled, vector).first()[0], "davies_bouldin": davies_bouldin(labelled, vector).first()[0]}
    return labelled, report


def cluster_job(rows: DataFrame, key: str, extract, fit, cache: FeatureCache, name: str, save, batch: int = 1000, cleanup: bool = True) -> tuple[DataFrame, dict]:
    """The whole run: features into a cache by batches, clusters, measures, ``save(labelled)``, and the cache dropped.

    ``extract`` maps rows with ``batch`` to (key, batch, embedding), ``fit`` maps
    features to (key, label). A run that breaks off while extracting goes on from
    its last batch, as the cache is dropped at the end only.
    """
    numbered = ranked(rows, key, name="_place").withColumn("batch", F.floor(F.col("_place") / batch)).drop("_place")
    cache.fill(name, numbered, extract)
    labelled, report = cluster_pipeline(cache.read(name), key, fit)
    save(labelled)
    if cleanup:
        cache.delete(name)
    return labelled, report
