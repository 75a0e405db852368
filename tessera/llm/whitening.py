"""Embedding whitening by a compensated covariance.

Vectors become whole numbers, whose sums per dimension are exact. Each task
centres its rows and adds up their outer products in double-double: sums and
products keep their rounding errors by error-free transformations. Tasks hand on
the high and low parts of tiles of the matrix, which are merged in two steps,
again in double-double. The eigenpairs come from tridiagonalisation and divide
and conquer, on the driver: a matrix as wide as a vector.

Defined results: a vector that is null or holds a null or non-finite component
is dropped; shorter vectors count as padded with zeros; whole numbers stay
within +-2^62, deviations at the limit of a long; rows that repeat an id are
rows of their own, null ids too; a component without variance has whitened
values and explained share 0 and takes no part in the identity error; equal
eigenvalues get any orthonormal basis, the same for all rows; fewer dimensions
than asked for give fewer components; an empty table gives no rows; other
columns, whatever their names, are ignored; long vectors make the matrix as
wide as themselves.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import doubledouble as dd
from tessera.llm import eigen
from tessera.llm.storage import written

TILE = 64
SPREAD = 32  # tasks of the first merge of a tile
_CELLS = 1 << 16  # products that are summed at once
_MOST = 2**62


def usable(vec: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(False))


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str, factor: float, offset: int) -> DataFrame:
    """(id, x array<bigint>): floor(factor * component) + offset of every usable vector."""
    most = float(_MOST - abs(offset))
    scaled = lambda c: F.greatest(F.least(c * F.lit(float(factor)), F.lit(most)), F.lit(-most))
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(scaled(c)).cast("long") + F.lit(offset))
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"), x.alias("x")).where(usable(F.col("_v"))).select("id", "x")


def matrix(column: pa.Array, d: int, fill: int | float) -> np.ndarray:
    """List rows as an array of ``d`` columns; what a row lacks is ``fill``."""
    flat, ends = column.flatten(), np.asarray(column.offsets).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if (sizes == d).all():
        return values.reshape(len(sizes), d)
    out = np.full((len(sizes), d), fill, dtype=values.dtype if len(values) else np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def exact_sums(whole: DataFrame, fill: int) -> tuple[int, list[int]]:
    """Number of rows and sum of each dimension, exact."""

    def run(batches):
        for batch in batches:
            column = batch.column("x")
            d = int(np.diff(np.asarray(column.offsets)).max(initial=0))
            x = matrix(column, d, 0)
            counts = np.bincount(np.arange(len(column.flatten())) - np.repeat(np.asarray(column.offsets)[:-1] - column.offsets[0].as_py(), np.diff(np.asarray(column.offsets))), minlength=d) if d else np.zeros(0, np.int64)
            safe = float(np.abs(x).max(initial=0)) * max(1, len(x)) < 2**62
            sums = [int(v) for v in (x if safe else x.astype(object)).sum(axis=0)]
            keys = [-1, *range(d)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([len(x), *counts.tolist()], pa.int64()), pa.array([str(v) for v in (0, *sums)])], ["k", "n", "s"])

    parts = whole.select("x").mapInArrow(run, "k int, n long, s string")
    got = {r["k"]: (r["n"], int(r["s"])) for r in parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = got.pop(-1, (0, 0))[0]
    return n, [got[k][1] + (n - got[k][0]) * fill for k in sorted(got)]


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as double-double; x may be whole numbers of up to 62 bits."""
    high = x.astype(float)
    low = (x - high.astype(np.int64)).astype(float) if x.dtype.kind == "i" else np.zeros_like(high)
    return dd.add(high, low, -mean[0], -mean[1])


def tiles_of(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the cells of each tile of the upper triangle."""
    out = []
    for a in range(0, d, TILE):
        for b in range(a, d, TILE):
            i, j = np.meshgrid(np.arange(a, min(a + TILE, d)), np.arange(b, min(b + TILE, d)), indexing="ij")
            up = i <= j
            out.append((i[up], j[up]))
    return out


def product_sums(high: np.ndarray, low: np.ndarray, cells: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over rows of the products of two columns each, as double-double."""
    i, j = cells
    up, down = dd.halves(high)
    sums = (np.zeros(len(i)), np.zeros(len(i)))
    step = max(1, _CELLS // max(1, len(i)))
    for at in range(0, len(high), step):
        h, lo, u, w = (v[at : at + step] for v in (high, low, up, down))
        p, e = dd.two_product(h[:, i], h[:, j], (u[:, i], w[:, i]), (u[:, j], w[:, j]))
        e += h[:, i] * lo[:, j] + lo[:, i] * h[:, j]
        sums = dd.add(*sums, *dd.total(*dd.quick_two_sum(p, e)))
    return sums


_PART = "tile int, part int, high binary, low binary"


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each (tile, part): its high and low parts added up, row by row."""

    def out(key, sums):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([sums[0].tobytes()], pa.binary()), pa.array([sums[1].tobytes()], pa.binary())], ["tile", "part", "high", "low"])

    def run(batches):
        key, sums = None, None
        for batch in batches:
            for tile, part, high, low in zip(*(batch.column(c).to_pylist() for c in ("tile", "part", "high", "low")), strict=True):
                mine = (np.frombuffer(high), np.frombuffer(low))
                if (tile, part) != key:
                    if key is not None:
                        yield out(key, sums)
                    key, sums = (tile, part), mine
                else:
                    sums = dd.add(*sums, *mine)
        if key is not None:
            yield out(key, sums)

    return parts.repartition("tile", "part").sortWithinPartitions("tile", "part").mapInArrow(run, _PART)


def covariance(rows: DataFrame, column: str, d: int, n: int, mean: tuple[np.ndarray, np.ndarray], fill: int | float = 0) -> np.ndarray:
    """Covariance (divisor n) of an array column, accumulated in double-double."""
    tiles = tiles_of(d)

    def run(batches):
        held: list = [None] * len(tiles)
        for batch in batches:
            high, low = centred(matrix(batch.column(column), d, fill), mean)
            for k, cells in enumerate(tiles):
                mine = product_sums(high, low, cells)
                held[k] = mine if held[k] is None else dd.add(*held[k], *mine)
        for k, sums in enumerate(held):
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([sums[0].tobytes()], pa.binary()), pa.array([sums[1].tobytes()], pa.binary())], ["tile", "part", "high", "low"])

    parts = rows.select(column).mapInArrow(run, _PART).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    done = _merged(_merged(parts).withColumn("part", F.lit(0)))
    out = np.zeros((d, d))
    for r in done.collect():  # as many cells as the matrix has
        i, j = tiles[r["tile"]]
        out[i, j] = out[j, i] = dd.divided(np.frombuffer(r["high"]), np.frombuffer(r["low"]), n)
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n * x - sum)^2, exact, at most the largest long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62 and x.shape[1] * most**2 < 2**63:
        t = n * x - np.array(sums, dtype=np.int64)
        return (t * t).sum(axis=1)
    if most < 2**62:
        t = n * x - np.array(sums, dtype=np.int64)
        if float(np.abs(t).max(initial=0)) ** 2 * x.shape[1] < 2**62:
            return (t * t).sum(axis=1)
    t = n * x.astype(object) - np.array(sums, dtype=object)
    return np.array([min(2**63 - 1, int(v)) for v in (t * t).sum(axis=1)], dtype=np.int64)


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, eigenvalue) for each usable row and component."""
    whole = written(whole_numbers(rows, id_col, vec_col, factor, offset), "whole")
    n, sums = exact_sums(whole, offset)
    d = len(sums)
    middle = [dd.nearest(Fraction(s, n)) for s in sums]
    mean = (np.array([m[0] for m in middle]), np.array([m[1] for m in middle]))
    v = covariance(whole, "x", d, n, mean, offset) if n and d else np.zeros((0, 0))
    values, vectors = eigen.symmetric(v)
    k = min(components, d)
    values, vectors = values[:k], vectors[:, :k]
    if k:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    trace = math.fsum(np.diag(v))
    some = values > d * float(np.finfo(float).eps) * max(values.max(initial=0), 0.0)
    scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)
    explained = [float(e / trace) if ok else 0.0 for e, ok in zip(values, some, strict=True)]
    kind = whole.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), d, offset)
            high, low = centred(x, mean)
            w = (high @ vectors + low @ vectors) * scale
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(x, n, sums)), flat], ["id", "deviation", "w"])

    projected = written(whole.mapInArrow(run, f"id {kind}, deviation long, w array<double>"), "whitened")
    error = _identity_error(projected, n, k, some) if n and k else 0.0
    named = projected.select("id", "deviation", F.posexplode("w").alias("c", "whitened"))
    share = lambda numbers: F.get(F.array(*[F.lit(float(x)) for x in numbers]) if k else F.array().cast("array<double>"), F.col("c"))
    return named.select("id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share(explained).alias("explained"), F.lit(error).alias("identity_error"), share(values).alias("eigenvalue"))


def _identity_error(projected: DataFrame, n: int, k: int, some: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over the components that vary."""
    got = projected.agg(*[F.avg(F.get("w", F.lit(c))).alias(f"m{c}") for c in range(k)]).first()
    mean = np.array([float(x) for x in got])
    c = covariance(projected, "w", k, n, (mean, np.zeros(k)), 0.0)[np.ix_(some, some)]
    return float(np.abs(c - np.eye(len(c))).max(initial=0.0))
