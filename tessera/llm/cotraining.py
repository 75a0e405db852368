"""Quality classifier by co-training a text-content view and a metadata view.

The text view sees the words of a text (hashed, A-Z lower-cased), and as
further columns its shape: n-grams over its letter, digit, space and
punctuation runs, and how much it repeats itself. The metadata view sees
source, language and page measures (length, lines, line length). Both are
logistic models. Over several rounds each view scores all unlabelled documents
and labels those that it is most sure of for the other view. Each view is then
calibrated on labelled rows that it wasn't trained on, the calibrated views
are combined there, and all documents are scored.

Defined results: null text counts as empty; null source and language are
values of their own; a null or missing length is taken from the text; of rows
that repeat an id one, with the least hash of its text, is a training row, and
all are scored; rows without an id are scored only; equally sure documents are
taken by id, then text hash; without labels of both classes every document gets
the share of good labels; an empty table gives no rows; columns beside those
named, whatever their names, are carried along; features of a text of any
length are taken over the whole of it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb
from tessera.llm.linededup import text_hash
from tessera.llm.quality_rules import _counts
from tessera.llm.storage import remove_table, write_table, written

WORD_BITS = 10
SHAPE_BITS = 10
META = 160
ROWS = 256  # rows whose features are held at once
_DENSE = 6
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")
_SHAPE[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RUNS = np.zeros(256, dtype=bool)
_RUNS[[ord("a"), ord("A"), ord("0"), 0x20]] = True


@dataclass
class View:
    """A logistic model with its calibration: logit = slope * (x @ weights + bias) + shift."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class CoTrained:
    text: View
    meta: View
    blend: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))


TEXT = (1 << WORD_BITS) + (1 << SHAPE_BITS) + _DENSE


def word_shares(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Share of each bucket of words in each text."""
    n, width = len(limits) - 1, 1 << WORD_BITS
    folded = _LOWER[data]
    starts, ends, rows = tb.word_spans(folded, limits)
    h = tb.span_hashes(tb.prefix_hashes(folded), starts, ends)
    bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    counts = np.bincount(rows * width + bucket, minlength=n * width).reshape(n, width)
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


def shape_shares(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Share of each bucket of shape n-grams in each text."""
    n, width = len(limits) - 1, 1 << SHAPE_BITS
    flat = np.zeros(n * width)
    rows = np.repeat(np.arange(n), np.diff(limits))
    shape = _SHAPE[data]
    if len(shape):
        keep = np.ones(len(shape), dtype=bool)
        keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]] | (rows[1:] != rows[:-1])
        shape, at = shape[keep].astype(np.uint32), rows[keep]
        for size in (1, 2, 3, 5):
            m = len(shape) - size + 1
            if m <= 0:
                break
            h = np.full(m, 2166136261 + size, dtype=np.uint32)
            for k in range(size):
                h = (h ^ shape[k : k + m]) * np.uint32(16777619)
            same = at[:m] == at[size - 1 :]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            flat += np.bincount(at[:m][same] * width + (h[same] >> np.uint32(32 - SHAPE_BITS)), minlength=n * width)
    shares = flat.reshape(n, width)
    return shares / np.maximum(1, shares.sum(axis=1, keepdims=True))


def text_features(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A row of word and shape shares (square roots) and repetition measures for each text."""
    words, chars, repeated = _counts(data, limits)
    size = np.maximum(1, words)
    dense = (repeated / size, np.minimum(1, words / 50), np.minimum(1, words / 500), np.log1p(words) / 10, np.minimum(2, chars / size / 10), words == 0)
    out = np.empty((len(words), TEXT), dtype=np.float32)
    a, b = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << SHAPE_BITS)
    np.sqrt(word_shares(data, limits), out=out[:, :a], casting="same_kind")
    np.sqrt(shape_shares(data, limits), out=out[:, a:b], casting="same_kind")
    out[:, b:] = np.stack(dense, axis=1)
    return out


def meta_features(source: list, lang: list, n_chars: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """One-hot source and language (hashed) and binned page measures."""
    out = np.zeros((len(source), META), dtype=np.float32)
    each = np.arange(len(source))
    slot = lambda x, n: [zlib.crc32(("-" if v is None else f"+{v}").encode()) % n for v in x]
    out[each, slot(source, 64)] = 1
    out[each, 64 + np.array(slot(lang, 16), dtype=np.int64)] = 1
    for base, x, step in ((80, n_chars, 2), (112, n_lines, 2), (136, n_chars / np.maximum(1, n_lines), 2)):
        room = 32 if base == 80 else 24
        out[each, base + np.minimum(room - 1, (np.log2(1 + np.maximum(0, x)) * step).astype(np.int64))] = 1
    return out


def both_features(batch: pa.RecordBatch):
    """Yield (from row, to row, text features, metadata features) over a batch of (id, text, lang, source, n_chars)."""
    data, limits = tb.string_buffers(batch.column("text"))
    source, lang, length = (batch.column(c).to_pylist() for c in ("source", "lang", "n_chars"))
    for low, high in tb.row_chunks(limits, 1_000_000):
        for a in range(low, high, ROWS):
            b = min(a + ROWS, high)
            part, local = data[limits[a] : limits[b]], limits[a : b + 1] - limits[a]
            ends = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum(part == 10, out=ends[1:])
            points = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=points[1:])
            own = (points[local[1:]] - points[local[:-1]]).astype(float)
            n_chars = np.array([own[k] if length[a + k] is None else float(length[a + k]) for k in range(b - a)])
            n_lines = ends[local[1:]] - ends[local[:-1]] + 1
            yield a, b, text_features(part, local), meta_features(source[a:b], lang[a:b], n_chars, n_lines)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 120, rate: float = 0.1) -> View:
    """Weighted logistic regression by Adam on all rows at once."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = (weight / weight.sum()).astype(np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        error = ((p - y) * weight).astype(np.float32)
        g, gb = x.T @ error + l2 * w, float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w = (w - rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)).astype(np.float32)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return View(w, float(b))


def _balance(y: np.ndarray) -> np.ndarray:
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, prior: float, more=None, rounds: int = 4, seed: int = 3) -> CoTrained:
    """Train from the feature rows of labelled documents.

    ``more(views, step)`` gives what each round adds: for a view's name the
    (features, labels) that the other view hands over.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        flat = lambda x: View(np.zeros(x.shape[1], np.float32), base)
        return CoTrained(flat(xt), flat(xm), np.array([0.5, 0.5, 0.0]))
    known = np.random.default_rng(seed).permutation(len(y))
    apart = np.zeros(len(y), dtype=bool)
    for value in (0, 1):
        own = known[y[known] == value]
        apart[own[: len(own) // 4]] = True
    train = known[~apart[known]]
    aside = known[apart[known]] if len(set(y[apart].tolist())) == 2 else train
    views: dict[str, View] = {}
    xs = {"text": xt, "meta": xm}
    given = {name: (x[:0], y[:0]) for name, x in xs.items()}  # what each view has received
    for step in range(rounds + 1):
        for name, x in xs.items():
            labels = np.concatenate([y[train], given[name][1]])
            weight = _balance(labels) * np.where(np.arange(len(labels)) < len(train), 1.0, 0.3)
            views[name] = fit_logistic(np.concatenate([x[train], given[name][0]]), labels, weight, 1e-4 if name == "text" else 1e-3)
        if step == rounds or more is None:
            break
        for name, (x, labels) in more(views, step).items():
            given[name] = (np.concatenate([given[name][0], x]), np.concatenate([given[name][1], labels]))
    weight = np.where(y[aside] == 1, prior / max(1, (y[aside] == 1).sum()), (1 - prior) / max(1, (y[aside] == 0).sum()))
    logits = []
    for name, x in xs.items():
        scale = fit_logistic(views[name].raw(x[aside])[:, None].astype(np.float32), y[aside], weight, 1e-3, 400)
        views[name].slope, views[name].shift = float(max(scale.weights[0], 0.0)), scale.bias
        logits.append(views[name].logit(x[aside]))
    mixed = fit_logistic(np.stack(logits, axis=1).astype(np.float32), y[aside], weight, 1e-3, 400)
    return CoTrained(views["text"], views["meta"], np.array([max(mixed.weights[0], 0.0), max(mixed.weights[1], 0.0), mixed.bias]))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list:
    there = lambda c, kind: (F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)).alias(c)
    return [F.col(id_col).alias("id"), F.col(text_col).alias("text"), there("lang", "string"), there("source", "string"), there("n_chars", "long")]


def _collected(sample: DataFrame) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows (id, mark), text features, metadata features) of a bounded sample of (id, mark, inputs), by id and mark."""

    def run(batches):
        for batch in batches:
            for a, b, xt, xm in both_features(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array([x.astype(np.float16).tobytes() for x in xt], pa.binary()), pa.array([x.astype(np.float16).tobytes() for x in xm], pa.binary())], ["id", "mark", "xt", "xm"])

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"id {kind}, mark long, xt binary, xm binary").toArrow().sort_by([("id", "ascending"), ("mark", "ascending")])
    unpack = lambda c, width: np.frombuffer(b"".join(got[c].to_pylist()), dtype=np.float16).reshape(-1, width).astype(np.float32)
    return got.select(["id", "mark"]), unpack("xt", TEXT), unpack("xm", META)


def sure_documents(docs: DataFrame, views: dict[str, View], sure: float) -> DataFrame:
    """(id, mark, text double, meta double): logits of documents that a view is sure of; ``mark`` is the text's hash."""
    shared = docs.sparkSession.sparkContext.broadcast(views)
    limit = float(np.log(sure / (1 - sure)))

    def run(batches):
        for batch in batches:
            for a, _, xt, xm in both_features(batch):
                z = [shared.value[name].raw(x).astype(float) for name, x in (("text", xt), ("meta", xm))]
                at = pa.array(a + np.flatnonzero((np.abs(z[0]) >= limit) | (np.abs(z[1]) >= limit)))
                keep = np.asarray(at) - a
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("mark").take(at), pa.array(z[0][keep]), pa.array(z[1][keep])], ["id", "mark", "text", "meta"])

    return docs.where(F.col("id").isNotNull()).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, mark long, text double, meta double")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", each_class: int = 1500, rounds: int = 4, each_round: int = 200, sure: float = 0.95, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> CoTrained:
    """Co-train on at most ``each_class`` labelled rows of each class, chosen by a seeded hash of their id.

    In each round both views score every unlabelled document; the
    ``each_round`` most sure ones of each class, over the whole table, become
    training rows of the other view. Only training rows come to the driver.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    marked = written(marked, "labels")
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    pick = lambda y: marked.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(each_class)
    table = docs.select(*_inputs(docs, id_col, text_col), text_hash(F.col(text_col)).alias("mark"))
    rows = table.join(F.broadcast(pick(0).unionByName(pick(1))), "id")
    one_each = rows.groupBy("id").agg(F.min(F.struct("mark", "text", "lang", "source", "n_chars", "y")).alias("x"))
    known, xt, xm = _collected(one_each.select("id", "x.text", "x.lang", "x.source", "x.n_chars", F.col("x.y").cast("long").alias("mark")))
    taken: dict[str, set] = {"text": set(), "meta": set()}

    def more(views: dict[str, View], step: int):
        path = write_table(sure_documents(table, views, sure), "sure")
        found = spark.read.schema(f"id {table.schema['id'].dataType.simpleString()}, mark long, text double, meta double").parquet(path)
        free = found.join(marked.select("id"), "id", "left_anti")
        chosen: dict[str, dict] = {"text": {}, "meta": {}}
        limit = float(np.log(sure / (1 - sure)))
        tops = None
        for name, other in (("text", "meta"), ("meta", "text")):
            for value, ranked in ((0, F.col(name)), (1, -F.col(name))):
                # As many more as earlier rounds may have taken.
                top = free.where(ranked <= -limit).select("id", "mark", ranked.alias("z")).distinct().orderBy("z", "id", "mark").limit(each_round * (step + 1) * 2)
                top = top.select(F.lit(other).alias("to"), F.lit(value).alias("y"), "z", "id", "mark")
                tops = top if tops is None else tops.unionByName(top)
        ranked_rows = sorted(tops.collect(), key=lambda r: (r["z"], r["id"], r["mark"]))
        for other in ("meta", "text"):
            for value in (0, 1):
                fresh = [(r["id"], r["mark"]) for r in ranked_rows if (r["to"], r["y"]) == (other, value) and (r["id"], r["mark"]) not in taken[other]][:each_round]
                chosen[other] |= {k: value for k in fresh if k not in chosen[other]}
            taken[other] |= set(chosen[other])
        remove_table(spark, path)
        wanted = sorted(set(chosen["text"]) | set(chosen["meta"]))
        if not wanted:
            return {}
        names = spark.createDataFrame(wanted, f"k {table.schema['id'].dataType.simpleString()}, m long")
        there = table.join(F.broadcast(names), (F.col("id") == F.col("k")) & (F.col("mark") == F.col("m")), "left_semi").dropDuplicates(["id", "mark"])
        at, new_text, new_meta = _collected(there)
        keys = list(zip(at["id"].to_pylist(), at["mark"].to_pylist(), strict=True))
        out = {}
        for name, x in (("text", new_text), ("meta", new_meta)):
            own = [k for k, key in enumerate(keys) if key in chosen[name]]
            out[name] = (x[own], np.array([chosen[name][keys[k]] for k in own], dtype=np.int64))
        return out

    return co_train(xt, xm, np.array(known["mark"].to_pylist(), dtype=np.int64), prior, more, rounds, seed)


def score(docs: DataFrame, model: CoTrained, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row struct of all columns, text_score, meta_score, score double, kept boolean) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("row"), *_inputs(docs, id_col, text_col))

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, xt, xm in both_features(batch):
                t, q = m.text.logit(xt).astype(float), m.meta.logit(xm).astype(float)
                p = sigmoid(m.blend[0] * t + m.blend[1] * q + m.blend[2])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(sigmoid(t)), pa.array(sigmoid(q)), pa.array(p), pa.array(p >= threshold)], ["row", "text_score", "meta_score", "score", "kept"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text_score double, meta_score double, score double, kept boolean")
