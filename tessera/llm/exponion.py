"""Exact k-means rounds over whole-numbered vectors by Exponion search.

Each vector keeps an upper bound of the distance to its centroid and a lower
bound of the distance to all others; when centroids move, the bounds move with
them. A vector whose bounds don't meet stays where it is unseen. For the others
the upper bound is made exact, and if it still meets the lower one, only the
centroids in a ball around the own centroid are scanned: its radius is twice the
upper bound and the distance to the nearest other centroid, so that it holds the
two nearest ones, and it is inclusive, so that it holds all that are as near.
The ball is a prefix of the centroid's list of others, sorted by distance.

The driver holds k centroids, their sums (whole numbers, exact) and nothing of
the vectors; bounds are columns of a table that each round writes anew.

Defined results: only vectors with ``d`` components, none null or non-finite,
take part; whole numbers stay within +-2^62 and squared distances and sums at
the limit of a long; rows that repeat an id are vectors of their own, and null
ids come last among the starts; equal starts are centroids of their own, of
which the first gets all vectors; fewer vectors than ``k`` give fewer
centroids; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import read_table, remove_table, write_table, written
from tessera.llm.whitening import matrix, whole_numbers

_LIMIT = 2**63 - 1
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50  # bounds stay bounds whatever is rounded


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows, as float64 where all are below 2^53, else as Python numbers."""
    d = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * d * most**2 < 2**53:
        a, b = x.astype(float), c.astype(float)
        return (a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)[None, :]
    a, b = x.astype(object), c.astype(object)
    return (a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)[None, :]


def own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """As ``squares``, of rows with the same number."""
    d = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    t = x - c if 4 * d * most**2 < 2**53 else x.astype(object) - c.astype(object)
    out = (t * t).sum(axis=1)
    return out.astype(float) if out.dtype != object else out


def root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float))


class Centroids:
    """Centroids with their distances and, for each, the others by rising distance."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, self.k = c, len(c)
        self.between = root(squares(c, c))
        self.order = np.argsort(self.between, axis=1, kind="stable")
        for a in range(self.k):  # the own centroid stands first, also before an equal one
            row = self.order[a]
            self.order[a] = np.concatenate([[a], row[row != a]])
        self.apart = np.take_along_axis(self.between, self.order, axis=1)
        self.nearest = self.apart[:, 1] * _DOWN if self.k > 1 else np.full(self.k, np.inf)
        moved = root(own_squares(c, before)) * _UP if before is not None else np.zeros(self.k)
        self.moved = moved
        top = np.argsort(-moved, kind="stable")[:2]
        #: how far any other centroid has moved
        self.others_moved = np.where(np.arange(self.k) == top[0], moved[top[-1]] if self.k > 1 else 0.0, moved[top[0]])

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, upper, lower, number of distances computed) of each vector after one assignment."""
        a, upper = a.copy(), upper + self.moved[a]
        lower = np.maximum(0.0, lower - self.others_moved[a])
        scanned = np.zeros(len(x), dtype=np.int64)
        limit = np.maximum(lower, self.nearest[a] / 2)
        open_ = np.flatnonzero(upper >= limit)
        upper[open_] = root(own_squares(x[open_], self.c[a[open_]])) * _UP
        scanned[open_] += 1
        open_ = open_[upper[open_] >= limit[open_]]
        if self.k == 1 or not len(open_):
            return a, upper, lower, scanned
        radius = (2 * upper[open_] + self.apart[a[open_], 1]) * _UP
        own = a[open_]
        reach = np.empty(len(open_), dtype=np.int64)
        for c in np.unique(own):
            mine = own == c
            reach[mine] = np.searchsorted(self.apart[c], radius[mine], side="right")
        # Vectors of one centroid are scanned together with those of about the same reach.
        step = np.minimum(self.k, 2 ** np.ceil(np.log2(np.maximum(reach, 2))).astype(np.int64))
        group = own * (2 * self.k + 1) + step
        by = np.argsort(group, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
            at = open_[part]
            near = self.order[own[part[0]], : step[part[0]]]
            s = squares(x[at], self.c[near])
            scanned[at] += len(near)
            least = s.min(axis=1)
            won = np.where(s == least[:, None], near[None, :], self.k).min(axis=1)
            s = s.astype(float)
            s[near[None, :] == won[:, None]] = np.inf
            a[at] = won
            upper[at] = root(least) * _UP
            lower[at] = root(s.min(axis=1)) * _DOWN  # the ball holds the second nearest too
        return a, upper, lower, scanned


_STATE = "x array<bigint>, a int, upper double, lower double, scanned long"


def assigned(state: DataFrame, now: Centroids) -> DataFrame:
    """The state (id, x, a, upper, lower, scanned) after one assignment."""
    shared = state.sparkSession.sparkContext.broadcast(now)
    kind = state.schema["id"].dataType.simpleString()

    def run(batches):
        centroids = shared.value
        d = centroids.c.shape[1]
        for batch in batches:
            x = matrix(batch.column("x"), d, 0)
            a, upper, lower, scanned = centroids.assign(x, *(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("a", "upper", "lower")))
            total = batch.column("scanned").to_numpy() + scanned
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(a.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(total)], ["id", "x", "a", "upper", "lower", "scanned"])

    return state.mapInArrow(run, f"id {kind}, {_STATE}")


def cluster_sums(state: DataFrame, k: int, d: int) -> dict[int, tuple[int, list[int]]]:
    """Size and exact sums of each non-empty cluster; tasks add up their own rows first."""

    def run(batches):
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=object)
        for batch in batches:
            x, a = matrix(batch.column("x"), d, 0), batch.column("a").to_numpy()
            n += np.bincount(a, minlength=k)
            if float(np.abs(x).max(initial=0)) * max(1, len(x)) < 2**62:
                part = np.zeros((k, d), dtype=np.int64)
                np.add.at(part, a, x)
                sums += part.astype(object)
            else:
                np.add.at(sums, a, x.astype(object))
        some = np.flatnonzero(n)
        for c in some.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([int(n[c])] * d, pa.int64()), pa.array([str(v) for v in sums[c]])], ["c", "k", "n", "s"])

    parts = state.select("x", "a").mapInArrow(run, "c int, k int, n long, s string")
    got = parts.groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k * d rows
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:
        out.setdefault(r["c"], (r["n"], [0] * d))[1][r["k"]] = int(r["s"])
    return out


def first_vectors(whole: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The vectors with the least SHA-256 of prefix and id, in that order."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256)
    rows = whole.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, d: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 256.0, prefix: str = "2:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned) of each usable vector.

    ``rounds`` times vectors are assigned and centroids moved to the floor of
    their means; then vectors are assigned once more. ``scanned`` counts the
    distances that were computed for a vector.
    """
    spark = rows.sparkSession
    sized = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.size("v") == d)
    whole = written(whole_numbers(sized, "id", "v", factor, 0), "whole")
    c = first_vectors(whole, k, prefix)
    kind = whole.schema["id"].dataType.simpleString()
    if not len(c):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long")
    state, path = whole.select("id", "x", F.lit(0).alias("a"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("scanned")), None
    before = None
    for turn in range(rounds + 1):
        after = assigned(state, Centroids(c, before))
        old, path = path, write_table(after, "assigned")
        state = read_table(after, path)
        if old:
            remove_table(spark, old)
        if turn < rounds:
            before, c = c, c.copy()
            for number, (n, sums) in cluster_sums(state, len(c), d).items():
                c[number] = [s // n for s in sums]
    return _described(state, c)


def _described(state: DataFrame, c: np.ndarray) -> DataFrame:
    spark = state.sparkSession
    kind, d = state.schema["id"].dataType.simpleString(), c.shape[1]
    shared = spark.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            x, a = matrix(batch.column("x"), d, 0), batch.column("a").to_numpy()
            s = own_squares(x, shared.value[a])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("a"), pa.array([min(_LIMIT, int(v)) for v in s], pa.int64()), batch.column("scanned")], ["id", "cluster", "distance", "scanned"])

    measured = state.mapInArrow(run, f"id {kind}, cluster int, distance long, scanned long")
    sums = {r["cluster"]: int(r["s"]) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = min(_LIMIT, sum(sums.values()))
    digest = lambda row: hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()
    table = spark.createDataFrame([(number, min(_LIMIT, s), total, digest(c[number])) for number, s in sorted(sums.items())], "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(table), F.col("cluster") == F.col("number")).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
