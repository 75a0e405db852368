"""Toxicity from bags of subword vectors.

A document is the mean of the vectors of the character n-grams of its different
words (3 to 6 UTF-8 bytes within a word, word limits included, ASCII
lower-cased, hashed to buckets; a repeated word counts once, and ``SMOOTH``
n-grams without a vector are added, so that a text of few words stays near the
base rate); a linear softmax over that mean gives the score. Vectors and softmax
are trained jointly, in numpy, on a bounded sample of labelled rows. A
misspelt word that was never seen still shares most of its n-grams with the
word it was made from. For scoring, vector and softmax fold into one number
for each bucket, so a text costs one table lookup for each n-gram.

Defined results: null and empty texts, and texts without n-grams, get the base
rate; without labels of both classes every text gets the base rate; rows with a
null id are never held out; repeated rows get equal scores; of rows that repeat
an id the one with the least hash of its text is a training row, once for each
label that its id has; an empty table gives no rows; other columns, whatever
their names, are ignored; all of a text of any length is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb
from tessera.llm.linededup import text_hash
from tessera.llm.storage import written

BUCKET_BITS = 16
SIZES = (3, 4, 5, 6)
SMOOTH = 600
_SPACE = np.uint8(32)
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _b in b"abcdefghijklmnopqrstuvwxyz0123456789@$":
    _FOLD[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_b] = _b + 32


@dataclass
class Model:
    """``table``: what each bucket adds to the mean logit; ``bias``: the logit of a text without n-grams."""

    table: np.ndarray
    bias: float


def gram_buckets(data: np.ndarray, limits: np.ndarray):
    """Yield (start positions, buckets, rows) for each n-gram size over the rows' folded bytes.

    Rows are set apart by a word limit, so that no n-gram crosses them.
    """
    n = len(limits) - 1
    rows = np.repeat(np.arange(n), np.diff(limits))
    text = np.full(len(data) + n + 1, _SPACE, dtype=np.uint8)
    text[np.arange(len(data)) + rows + 1] = _FOLD[data]
    row_of = np.zeros(len(text), dtype=np.int32)
    row_of[np.arange(len(data)) + rows + 1] = rows
    ends = limits[1:] + np.arange(n) + 1
    row_of[ends] = np.arange(n)
    row_of[limits[:-1] + np.arange(n)] = np.arange(n)
    space = text == _SPACE
    words = ~space
    words[1:] &= space[:-1]
    starts = np.flatnonzero(words)
    if not len(starts):
        return
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    h = tb.mix64(tb.span_hashes(tb.prefix_hashes(text), starts, ends) ^ tb.mix64(row_of[starts].astype(np.uint64)))
    fresh = np.zeros(len(starts), dtype=bool)
    fresh[np.unique(h, return_index=True)[1]] = True
    kept = np.zeros(len(text), dtype=bool)  # places in the first occurrence of a word in its row
    kept[:-1] = np.repeat(np.append(False, fresh), np.diff(np.concatenate([[0], starts, [len(text) - 1]])))
    wide = text.astype(np.uint32)
    for size in SIZES:
        m = len(text) - size + 1
        if m <= 0:
            return
        h = np.full(m, 2166136261 + size, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        for k in range(size):
            h ^= wide[k : k + m]
            h *= np.uint32(16777619)
            if 0 < k < size - 1:
                inner |= space[k : k + m]
        at = np.flatnonzero(kept[1 : m + 1] & ~inner & ~(space[:m] & space[size - 1 : size - 1 + m]))
        h = h[at]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield at, (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), row_of[at + 1]


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets (uint16) and how often each stands in the different words of each text (uint32)."""
    data, limits = tb.string_buffers(column)
    out = []
    for low, high in tb.row_chunks(limits, 1_000_000):
        part = [(row, bucket) for _, bucket, row in gram_buckets(data[limits[low] : limits[high]], limits[low : high + 1] - limits[low])]
        key = np.concatenate([r.astype(np.int64) << BUCKET_BITS | b for r, b in part]) if part else np.zeros(0, np.int64)
        key, count = np.unique(key, return_counts=True)
        row, bucket = key >> BUCKET_BITS, (key & ((1 << BUCKET_BITS) - 1)).astype(np.uint16)
        cut = np.searchsorted(row, np.arange(high - low + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            out.append((bucket[a:b], count[a:b].astype(np.uint32)))
    return out


def shares(count: np.ndarray) -> np.ndarray:
    """Shares of a text's buckets, the added n-grams among the whole."""
    return (count / (count.sum() + SMOOTH)).astype(np.float32)


def text_logits(column: pa.Array, model: Model) -> np.ndarray:
    data, limits = tb.string_buffers(column)
    out = np.full(len(column), model.bias)
    for low, high in tb.row_chunks(limits, 1_000_000):
        total, count = np.zeros(high - low), np.zeros(high - low)
        for _, bucket, row in gram_buckets(data[limits[low] : limits[high]], limits[low : high + 1] - limits[low]):
            total += np.bincount(row, weights=model.table[bucket], minlength=high - low)
            count += np.bincount(row, minlength=high - low)
        out[low:high] += total / (count + SMOOTH)
    return out


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, dim: int = 8, steps: int = 500, batch: int = 128, rate: float = 0.5, scale: float = 200.0, decay: float = 1e-6, seed: int = 5) -> Model:
    """Joint training of n-gram vectors and a two-class softmax by Adagrad.

    ``prior`` is the share of class 1 among all labelled rows; classes are
    weighted equally while training and the bias is put back to the prior.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), base)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (1 << BUCKET_BITS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    grown = [np.full(x.shape, 1e-3, np.float32) for x in (vectors, soft, bias)]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    used = np.unique(np.concatenate([b for b, _ in features])) if features else np.zeros(0, np.uint16)
    columns, everything = [np.searchsorted(used, b).astype(np.uint16) for b, _ in features], vectors
    vectors, grown[0] = vectors[used], grown[0][used]
    dense = np.zeros((batch, len(used)), np.float32)
    done = 0
    while done < steps:
        order = rng.permutation(len(labels))
        for start in range(0, len(order), batch):
            done += 1
            part = order[start : start + batch]
            dense.fill(0)
            for row, k in enumerate(part):
                dense[row, columns[k]] = shares(features[k][1])
            x = dense[: len(part)]
            hidden = (x @ vectors) * scale
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= (weight[part] / len(part))[:, None].astype(np.float32)
            step_soft, step_bias, step_vectors = hidden.T @ p, p.sum(axis=0), (x.T @ (p @ soft.T)) * scale + decay * vectors
            for at, g, step in zip((vectors, soft, bias), grown, (step_vectors, step_soft, step_bias), strict=True):
                g += step**2
                at -= rate * step / np.sqrt(g)
    everything[:] = 0  # an n-gram that training never met says nothing
    everything[used] = vectors
    table = (everything @ (soft[:, 1] - soft[:, 0]) * scale).astype(np.float32)
    return Model(table, base)


def held_out(id_col: str = "doc_id"):
    """True for rows whose crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def within(chance: np.ndarray, labels: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Rows in order of ``chance`` whose running size in their class stays within half of ``most``."""
    keep = np.zeros(len(labels), dtype=bool)
    for value in (0, 1):
        own = np.flatnonzero(labels == value)
        own = own[np.argsort(chance[own], kind="stable")]
        keep[own] = np.cumsum(sizes[own]) <= most // 2
    return keep


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", each_class: int = 3000, most_entries: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> Model:
    """Train on at most ``each_class`` labelled rows of each class, chosen by a seeded hash.

    The driver takes them in that order up to ``most_entries`` buckets in all
    (6 bytes each, half of it for each class). These bounds are the only
    limits; labels of held-out rows are never read.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).distinct()
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    chance = F.xxhash64(F.lit(seed), "id")
    pick = lambda y: marked.where(F.col("y") == y).orderBy(chance, "id").limit(each_class)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("version")).join(chosen, "id")
    sample = rows.groupBy("id", "y").agg(F.min(F.struct("version", "text")).alias("x")).select("id", "y", chance.alias("chance"), "x.text")

    def run(batches):
        for batch in batches:
            found = bags(batch.column("text"))
            packed = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("chance"), pa.array([len(x[0]) for x in found], pa.int64()), *packed], ["id", "y", "chance", "size", "buckets", "counts"])

    kind = sample.schema["id"].dataType.simpleString()
    found = written(sample.mapInArrow(run, f"id {kind}, y int, chance long, size long, buckets binary, counts binary"), "bags")
    sizes = found.select("id", "y", "chance", "size").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    chance_, y, size = (sizes[c].to_numpy() for c in ("chance", "y", "size"))
    keep = within(chance_, y, size, most_entries)
    kept = found if keep.all() else found.join(F.broadcast(docs.sparkSession.createDataFrame(list(zip(sizes["id"].filter(pa.array(keep)).to_pylist(), y[keep].tolist(), strict=True)), f"id {kind}, y int")), ["id", "y"], "left_semi")
    got = kept.select("id", "y", "buckets", "counts").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    features = [(np.frombuffer(b.as_buffer(), np.uint16), np.frombuffer(c.as_buffer(), np.uint32)) for b, c in zip(got["buckets"], got["counts"], strict=True)]
    return train(features, np.asarray(got["y"].to_pylist(), dtype=np.int64), prior, seed=seed)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score double, predicted int) for every row; only the text is an input of the score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(text_logits(batch.column("text"), shared.value), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
