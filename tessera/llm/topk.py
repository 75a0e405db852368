"""Exact top-k by inner product with block-at-a-time pruning.

Candidates are laid out by the signs of a few fixed projections, then id, and
cut into document-range blocks, each with a forward index (its matrix) and the
largest and smallest value of every term (component). For a query the sum of
its best possible term products bounds every score in a block. Blocks are taken
in falling order of that bound until it is below the k-th best score so far.
Inside a block the forward index is scored term group by term group: what the
terms still to come can add to a row (their summed maxima, or the product of
what is left of both vectors' lengths, whichever is less) decides whether the
row is scored to its end. Seed rows give each query a first k-th score. Queries
travel in chunks, to the parts of the candidates that their bounds leave.

Defined results: a vector that is null, or holds a null or non-finite
component, takes no part; shorter vectors count as padded with zeros; a query
never meets rows of its own id; rows that repeat an id are candidates of their
own, with the smaller id first among equal scores; scores beyond the range of a
long stay at its limit; empty tables give no rows; other columns, whatever
their names, are ignored; a long vector makes its block as wide as itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import written

BLOCK = 256
PART = 4096
CHUNK = 128
SEEDS = 2048
SPANS = 1024  # runs of parts whose limits are known where chunks are sent from
HEAD = 0.75  # share of the terms that every row of an open block is scored by
_SIGNS = 16
_LIMIT = 2**63 - 1


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-valued float64 rows, as int64."""
    d = max(q.shape[1], x.shape[1], 1)
    high = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d
    if high < 2**53:
        return (q @ x.T).astype(np.int64)
    if high < 2**62 and np.abs(q).max() < 2**62 and np.abs(x).max() < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    exact = whole(q) @ whole(x).T
    return np.array([[min(_LIMIT, max(-_LIMIT - 1, v)) for v in row] for row in exact], dtype=np.int64).reshape(len(q), len(x))


def _pad(a: np.ndarray, d: int) -> np.ndarray:
    return a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1])))


_EMPTY = -_LIMIT - 1


def bounds_of(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What no score of a query with a vector inside the limits exceeds; above any rounding of the sums."""
    d = max(q.shape[1], high.shape[1])
    q = _pad(q, d)
    out = np.maximum(q, 0) @ _pad(high, d).T + np.minimum(q, 0) @ _pad(low, d).T
    return out + np.abs(out) * 1e-9 + 1


def _below(scores: np.ndarray) -> np.ndarray:
    """Scores as floats that are not above them."""
    out = scores.astype(float)
    return out - np.abs(out) * 1e-12


class Part:
    """The blocks of one part of the candidates, with their term limits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int = BLOCK):
        self.d, self.head = x.shape[1], max(1, int(x.shape[1] * HEAD))
        self.blocks = [(ids[a : a + block], x[a : a + block]) for a in range(0, len(ids), block)]
        self.high = np.stack([b.max(axis=0) for _, b in self.blocks])
        self.low = np.stack([b.min(axis=0) for _, b in self.blocks])
        self.rest = [np.sqrt((b[:, self.head :] ** 2).sum(axis=1)) for _, b in self.blocks]
        self.most = float(np.abs(x).max(initial=0))
        self.opened = self.scored = 0  # pairs in opened blocks, pairs scored to their end

    def _scores(self, b: int, q: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of a block's pairs that may reach the k-th score."""
        x, m = self.blocks[b][1], self.head
        self.opened += len(q) * len(x)
        if float(np.abs(q).max(initial=0)) * self.most * self.d >= 2**53:
            self.scored += len(q) * len(x)
            s = exact_scores(q, _pad(x, q.shape[1]))
            r, c = np.nonzero(s >= kth[:, None])
            return r, c, s[r, c]
        q = q[:, : self.d]  # a query's further terms meet zeros
        s = q[:, :m] @ x[:, :m].T
        left = np.sqrt((q[:, m:] ** 2).sum(axis=1))[:, None] * self.rest[b][None, :]
        box = np.maximum(q[:, m:], 0) @ self.high[b, m:] + np.minimum(q[:, m:], 0) @ self.low[b, m:]
        r, c = np.nonzero(s + np.minimum(left, box[:, None]) * (1 + 1e-9) + 1 >= kth[:, None])
        self.scored += len(r)
        if 4 * len(r) > s.size:
            s = (s + q[:, m:] @ x[:, m:].T)[r, c]
        else:
            s = s[r, c] + np.einsum("ij,ij->i", q[r, m:], x[c, m:])
        return r, c, s.astype(np.int64)

    def search(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each query's k best rows that reach its floor; ``_EMPTY`` where there are fewer."""
        q = _pad(q, max(self.d, q.shape[1]))
        bounds = bounds_of(q, self.high, self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        scores = np.full((len(q), k), _EMPTY, dtype=np.int64)
        ids = np.full((len(q), k), _LIMIT, dtype=np.int64)
        kth, each = _below(floor), np.arange(len(q))
        for turn in range(len(self.blocks)):
            at = order[:, turn]
            live = np.flatnonzero(bounds[each, at] >= kth)
            if not len(live):
                break
            for b in np.unique(at[live]):
                rows = live[at[live] == b]
                r, c, s = self._scores(b, q[rows], kth[rows])
                found = self.blocks[b][0][c]
                ok = (found != q_ids[rows[r]]) & (s >= floor[rows[r]])
                if ok.any():
                    take_best(scores, ids, rows[r[ok]], s[ok], found[ok])
                    kth[rows] = np.maximum(_below(floor[rows]), _below(scores[rows, -1]))
        return scores, ids


def take_best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, s: np.ndarray, found: np.ndarray) -> None:
    """Merge (row, score, id) candidates into each row's best: highest score first, then smaller id."""
    k, touched = scores.shape[1], np.unique(rows)
    every = np.concatenate([np.repeat(touched, k), rows])
    value, name = np.concatenate([scores[touched].ravel(), s]), np.concatenate([ids[touched].ravel(), found])
    order = np.lexsort((name, ~value, every))  # ~v orders like -v and has no overflow
    first = np.searchsorted(every[order], touched)
    pick = order[(first[:, None] + np.arange(k)[None, :]).ravel()]
    scores[touched], ids[touched] = value[pick].reshape(-1, k), name[pick].reshape(-1, k)


def sign_place(x: np.ndarray, planes: dict[int, np.ndarray]) -> int:
    """A number whose bits are the signs of fixed projections: vectors of like direction have near numbers."""
    if len(x) not in planes:
        planes[len(x)] = np.random.default_rng(len(x)).normal(size=(_SIGNS, len(x)))
    return int(np.packbits(planes[len(x)] @ x >= 0).view(">u2")[0])


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, factor: float = 256.0) -> DataFrame:
    """(id long, d int, place int, data binary): floor(factor * x) of every usable vector, as float64."""
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, out, dims, places = [], [], [], []
            for i, vec in zip(batch.column("id").to_pylist(), batch.column("vec"), strict=True):
                values = vec.values
                if values.null_count:
                    continue
                x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * factor)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(x.tobytes())
                    places.append(sign_place(x, planes))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(places, pa.int32()), pa.array(out, pa.binary())], ["id", "d", "place", "data"])

    return source.mapInArrow(run, "id long, d int, place int, data binary")


def _matrix(dims: list[int], data: list[bytes]) -> np.ndarray:
    out = np.zeros((len(dims), max(dims, default=0)))
    for k, (d, raw) in enumerate(zip(dims, data, strict=True)):
        out[k, :d] = np.frombuffer(raw)
    return out


_PACKED = "part int, kind int, n int, d int, ids binary, data binary, floors binary"


def _packer(kind: int, size: int, floors):
    """Arrow function that packs consecutive (part, id, d, data) rows of a part into matrices of ``size`` rows."""

    def flush(part, ids, dims, data):
        x = _matrix(dims, data)
        ids = np.array(ids, dtype=np.int64)
        low = floors(ids, x) if floors else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (ids, x, low)]],
            ["part", "kind", "n", "d", "ids", "data", "floors"],
        )

    def run(batches):
        held: tuple[int | None, list, list, list] = (None, [], [], [])
        for batch in batches:
            for part, i, d, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "d", "data")), strict=True):
                if part != held[0] or len(held[1]) >= size:
                    if held[1]:
                        yield flush(*held)
                    held = (part, [], [], [])
                held[1].append(i)
                held[2].append(d)
                held[3].append(raw)
        if held[1]:
            yield flush(*held)

    return run


def part_limits(candidates: DataFrame, n_parts: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(parts in a run, largest, smallest value of each term) of at most ``SPANS`` runs of parts."""
    width = -(-n_parts // SPANS)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"]).reshape(r["n"], r["d"])
                k = np.arange(r["d"], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r["part"] // width, np.int32)), pa.array(k), pa.array(x.max(axis=0)), pa.array(x.min(axis=0))], ["run", "k", "high", "low"])

    got = candidates.select("part", "n", "d", "data").mapInArrow(run, "run int, k int, high double, low double").groupBy("run", "k").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("blocks")).toArrow()
    size = (-(-n_parts // width), max(got["k"].to_pylist(), default=-1) + 1)
    high, low = np.zeros(size), np.zeros(size)
    at = (got["run"].to_numpy(), got["k"].to_numpy())
    high[at], low[at] = got["high"].to_numpy(), got["low"].to_numpy()
    blocks = np.zeros(size, dtype=np.int64)
    blocks[at] = got["blocks"].to_numpy()
    padded = blocks < blocks.max(axis=1, initial=0)[:, None]  # some block of the run has fewer terms: zeros
    high[padded], low[padded] = np.maximum(high[padded], 0), np.minimum(low[padded], 0)
    return width, high, low


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 256.0, part_rows: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows, highest score first, then smaller id.

    The driver holds ``SEEDS`` rows and the term limits of ``SPANS`` runs of
    parts, whatever the input.
    """
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, id_col, vec_col, factor), "vectors")
    n = vectors.count()
    ranged = vectors.repartitionByRange(max(1, -(-n // part_rows)), "place", "id").sortWithinPartitions("place", "id").withColumn("part", F.spark_partition_id())
    candidates = written(ranged.mapInArrow(_packer(0, BLOCK, None), _PACKED), "blocks")
    n_parts = 1 + (candidates.agg(F.max("part")).first()[0] or 0)  # what the ranges came to
    # A bounded set of seed rows, the same for all queries, gives each a first k-th score.
    seed = vectors.orderBy(F.xxhash64("id", "data")).limit(SEEDS).select("id", "d", "data").collect()
    known = (np.array([r["id"] for r in seed], dtype=np.int64), _matrix([r["d"] for r in seed], [r["data"] for r in seed]))
    shared = spark.sparkContext.broadcast((known, part_limits(candidates, n_parts)))

    def floors(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        s_ids, s = shared.value[0]
        d = max(x.shape[1], s.shape[1])
        scores = np.where(ids[:, None] == s_ids[None, :], _EMPTY, exact_scores(_pad(x, d), _pad(s, d)))
        return np.partition(scores, len(s_ids) - k, axis=1)[:, len(s_ids) - k].astype(np.int64) if len(s_ids) >= k else np.full(len(ids), _EMPTY, dtype=np.int64)

    asked = vectors.where(is_query_on(is_query)).dropDuplicates(["id", "data"]).withColumn("part", F.lit(0))
    # Queries of like direction share a chunk, so that the parts they leave out are the same.
    dealt = asked.repartitionByRange("place", "id").sortWithinPartitions("place", "id")
    chunks = dealt.mapInArrow(_packer(1, CHUNK, floors), _PACKED)

    def sent(batches):
        """Each chunk once for every part that may hold a score at one of its floors: a stated query set against all rows, in blocks."""
        width, high, low = shared.value[1]
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                x, floor = np.frombuffer(r["data"]).reshape(r["n"], r["d"]), np.frombuffer(r["floors"], np.int64)
                runs = np.flatnonzero((bounds_of(x, high, low) >= _below(floor)[:, None]).any(axis=0))
                parts = (runs[:, None] * width + np.arange(width)[None, :]).ravel()
                for part in parts[parts < n_parts].tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[batch.column(c).slice(k, 1) for c in ("kind", "n", "d", "ids", "data", "floors")]], ["part", "kind", "n", "d", "ids", "data", "floors"])

    together = candidates.unionByName(chunks.mapInArrow(sent, _PACKED)).repartition(n_parts, "part").sortWithinPartitions("part", "kind")

    def run(batches):
        at, ids, xs, ready = None, [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != at:
                    at, ids, xs, ready = r["part"], [], [], None
                x, i = np.frombuffer(r["data"]).reshape(r["n"], r["d"]), np.frombuffer(r["ids"], np.int64)
                if r["kind"] == 0:
                    ids.append(i)
                    xs.append(x)
                    continue
                if not xs:
                    continue
                if ready is None:
                    d = max(v.shape[1] for v in xs)
                    ready = Part(np.concatenate(ids), np.concatenate([_pad(v, d) for v in xs]))
                floor = np.frombuffer(r["floors"], np.int64)
                scores, found = ready.search(i, x, floor, k)
                kept = (scores != _EMPTY) & (scores >= floor[:, None])
                row, _ = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(i[row]), pa.array(_mark(x)[row]), pa.array(found[kept]), pa.array(scores[kept])], ["query_id", "version", "vec_id", "score"])

    met = together.mapInArrow(run, "query_id long, version long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _mark(x: np.ndarray) -> np.ndarray:
    """A number for each query vector, so that rows that share an id stay apart."""
    return np.array([int.from_bytes(hashlib.blake2b(np.trim_zeros(v, "b").tobytes(), digest_size=8).digest(), "big", signed=True) for v in x], dtype=np.int64)


def is_query_on(condition: Column) -> Column:
    """The condition, which names the id column ``id``; null is no query."""
    return F.coalesce(condition, F.lit(False))
