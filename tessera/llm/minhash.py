"""Near-duplicate classes by improved consistent weighted sampling.

Documents are weighted sets of word shingles, weight = (1 + ln tf) * idf. The
idf of a shingle is ln(N / df) in units of ln ``COMMON``, at most 1 and at least
``floor``, where N and df count different texts: one document stands for each
group of documents that are alike. So the copies of a text don't make common what
they share, and their edits don't outweigh it. The groups are candidate groups by
a first idf over all documents, which copies do sway and which therefore only
falls from 1 to 1 - ``span``; it stays where it is the lesser one. A shingle in
fewer than ``FEW`` texts is not common. The tables of common shingles have a
bound (a multiple of ``COMMON`` times the mean number of shingles of a document),
whatever the input. Improved consistent
weighted sampling (one sample of all shingles for each slot; for heavy
documents one sample for each of as many bins, empty bins borrowing) gives a
sketch, its bands give buckets. Documents of a bucket whose sketches are alike
are linked into candidate groups, a few links for each. In a group, cut into
blocks of bounded size, the exact weighted Jaccard similarity is taken from
every document to all others that have no class yet and are not clearly apart by
sketch, inside a block and between any two blocks; documents at or above the
threshold share a class.

Defined results: documents with the same words in the same order (null, empty
and blank texts among them) are one class without any sampling; texts of fewer
words than a shingle have one shingle of all their words; repeated rows share a
class, and so do pairs exactly at the threshold; ids may be null; an empty table
gives no rows; other columns, whatever their names, are ignored; a text of any
length is shingled whole, in memory linear in its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb
from tessera.llm.components import connected_components
from tessera.llm.linededup import text_hash
from tessera.llm.storage import written

U = np.uint64
SLOTS, BANDS = 64, 16
COMMON, REPORT, LOSS, SPAN = 64, 256, 1024, 0.1
FEW, FLOOR = 10, 0.1
FULL_WEIGHT = 160.0  # up to this weight a document gets a full sample for each slot


class Idf:
    """Sorted hashes of common shingles with their factors; every other shingle has factor 1."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_docs: int, span: float = SPAN):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        ratio = np.minimum(1.0, counts[order] / max(1, n_docs))
        self.factors = 1 - span * np.clip(np.log(np.maximum(ratio * COMMON, 1)) / np.log(COMMON), 0, 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.factors[at[hit]]
        return out

    def lowered(self, hashes: np.ndarray, counts: np.ndarray, n_texts: int, floor: float = FLOOR) -> tuple[Idf, np.ndarray]:
        """With the factors that the counts over different texts give where they are less; and the sorted hashes of these."""
        by_text = np.clip(np.log(max(1, n_texts) / np.maximum(counts, 1)) / np.log(COMMON), floor, 1)
        less = (counts >= FEW) & (by_text < self(hashes))
        every = np.union1d(self.hashes, hashes[less])
        out = Idf(every, np.zeros(len(every)), 1)
        out.factors = self(every)
        out.factors[np.searchsorted(out.hashes, hashes[less])] = by_text[less]
        return out, np.sort(hashes[less])


def row_shingles(data: np.ndarray, limits: np.ndarray, size: int):
    """(rows, hashes, times) of each text's distinct shingles, by row; then two hashes of each row's words in order."""
    n = len(limits) - 1
    starts, ends, rows = tb.word_spans(data, limits)
    words = tb.span_hashes(tb.prefix_hashes(data), starts, ends)
    h, r = tb.shingles(words, rows, size, n)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(h)))
    keys = np.zeros((n, 2), dtype=np.uint64)
    if len(words):
        counts = np.bincount(rows, minlength=n)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = tb.mix64((np.arange(len(words)) - first[rows]).astype(np.uint64) + U(11))
        has = counts > 0
        for k, mark in enumerate((U(0x5851F42D4C957F2D), U(0x14057B7EF767814F))):
            keys[has, k] = tb.mix64(np.add.reduceat(tb.mix64(words * mark + place), first[has]))
    return r[at], h[at], times, keys


def _chunks(column: pa.Array, most: int = 2_000_000):
    data, limits = tb.string_buffers(column)
    for low, high in tb.row_chunks(limits, most):
        yield low, high, data[limits[low] : limits[high]], limits[low : high + 1] - limits[low]


def shingle_reports(docs: DataFrame, size: int, text_col: str) -> tuple[DataFrame, int]:
    """(h, over, docs) of what may be common in a partition, and the number of documents.

    Counts with loss in each partition and reports what may be in 1 / REPORT of
    its documents. What a partition doesn't report is below that, so the reports
    bound every shingle's count from above.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    # Small partitions would report all they have: some are taken together.
    parts_now, least = texts.rdd.getNumPartitions(), 4 * docs.sparkSession.sparkContext.defaultParallelism
    fewer = texts.coalesce(max(least, parts_now // 8)) if parts_now > least else texts

    def candidates(batches):
        hashes, counts, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        slack = np.zeros(0, np.int64)
        for batch in batches:
            for low, high, data, limits in _chunks(batch.column("text")):
                _, h, _, _ = row_shingles(data, limits, size)
                found, times = np.unique(h, return_counts=True)
                merged, back = np.unique(np.concatenate([hashes, found]), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([counts, times]), minlength=len(merged)).astype(np.int64)
                missed = np.full(len(merged), n // LOSS, dtype=np.int64)
                missed[back[: len(hashes)]] = slack
                n += high - low
                keep = total + missed > n // LOSS
                hashes, counts, slack = merged[keep], total[keep], missed[keep]
        keep = (counts + slack) * REPORT >= n
        if n:
            # The last row holds the number of documents.
            over = (counts[keep] + slack[keep]) * REPORT - n
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes[keep].view(np.int64), 0)), pa.array(np.append(over, 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), n))], ["h", "over", "docs"])

    parts = written(fewer.mapInArrow(candidates, "h long, over long, docs long"), "common")
    n_docs = parts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    return parts, n_docs


def reported(parts: DataFrame, n_docs: int, least: float) -> np.ndarray:
    """Sorted hashes of all shingles that by their reports may be in ``least`` documents, n_docs / REPORT or more."""
    bound = parts.where("docs = 0").groupBy("h").agg(F.sum("over").alias("over")).where(F.col("over") + n_docs >= least * REPORT)
    names = np.array([r["h"] for r in bound.select("h").collect()], dtype=np.int64).view(np.uint64)
    names.sort()
    return names


def shingle_counts(docs: DataFrame, names: np.ndarray, size: int, text_col: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``names`` that are in ``least`` documents, and their exact document counts."""
    if not len(names):
        return names, np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def exact(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for _, _, data, limits in _chunks(batch.column("text")):
                _, h, _, _ = row_shingles(data, limits, size)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                total += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        there = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[there].view(np.int64)), pa.array(total[there])], ["h", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    return np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in rows], dtype=float)


def common_shingles(docs: DataFrame, size: int, text_col: str, span: float = SPAN, reports: tuple[DataFrame, int] | None = None) -> tuple[Idf, int]:
    """Exact document counts of all shingles in at least 1 / COMMON of the documents.

    The few that may be so common by the reports (fewer than 2 * COMMON times the
    mean number of shingles of a document, whatever the input) are counted exactly.
    """
    parts, n_docs = reports or shingle_reports(docs, size, text_col)
    least = n_docs / COMMON
    return Idf(*shingle_counts(docs, reported(parts, n_docs, least), size, text_col, least), n_docs, span), n_docs


def _sample(h: np.ndarray, log_w: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling: (ln a, sample hash) of each weighted shingle for one slot."""
    unit = 2.0**-32
    z = tb.mix64(h ^ U(key))
    z2 = tb.mix64(z + U(0x9E3779B97F4A7C15))
    z3 = tb.mix64(z2 + U(0x9E3779B97F4A7C15))
    u = lambda x, s: ((x >> U(s) & U(0xFFFFFFFF)).astype(np.float64) + 0.5) * unit
    r = -np.log(u(z, 32) * u(z, 0))
    log_c = np.log(-np.log(u(z2, 32) * u(z2, 0)))
    beta = u(z3, 32)
    t = np.floor(log_w / r + beta)
    return log_c - r * (t - beta + 1), tb.mix64(h + t.astype(np.int64).view(np.uint64) * U(0xD1342543DE82EF95))


_KEYS = [int(x) for x in np.random.default_rng(77).integers(1, 2**63, SLOTS + 2)]


def _least(values: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The mark at the least value of each run."""
    low = np.minimum.reduceat(values, starts)
    hit = np.flatnonzero(values == np.repeat(low, np.diff(np.append(starts, len(values)))))
    return marks[hit[np.searchsorted(hit, starts)]]


def sketches(r: np.ndarray, h: np.ndarray, w: np.ndarray, n: int):
    """Yield (kind, rows, slots uint64[rows, SLOTS]); kind 0 is a full sample, kind 1 one by bins."""
    total = np.bincount(r, weights=w, minlength=n)
    log_w = np.log(w)
    light = total[r] <= FULL_WEIGHT
    if light.any():
        rows, starts = np.unique(r[light], return_index=True)
        out = np.empty((len(rows), SLOTS), dtype=np.uint64)
        hl, wl = h[light], log_w[light]
        for k in range(SLOTS):
            a, mark = _sample(hl, wl, _KEYS[k])
            out[:, k] = _least(a, starts, mark)
        yield 0, rows, out
    heavy = total[r] > 0.8 * FULL_WEIGHT
    if heavy.any():
        rows, back = np.unique(r[heavy], return_inverse=True)
        hh = h[heavy]
        a, mark = _sample(hh, log_w[heavy], _KEYS[SLOTS])
        seat = back * SLOTS + (tb.mix64(hh ^ U(_KEYS[SLOTS + 1])) >> U(58)).astype(np.int64)
        order = np.argsort(seat, kind="stable")
        seats, starts = np.unique(seat[order], return_index=True)
        out, there = np.zeros(len(rows) * SLOTS, dtype=np.uint64), np.zeros(len(rows) * SLOTS, dtype=bool)
        out[seats] = _least(a[order], starts, mark[order])
        there[seats] = True
        empty, turn = np.flatnonzero(~there), 0
        while len(empty):
            turn += 1
            slot = (empty % SLOTS).astype(np.uint64)
            source = empty // SLOTS * SLOTS + (tb.mix64(slot + U(turn * 1000)) >> U(58)).astype(np.int64)
            ok = there[source]
            out[empty[ok]] = tb.mix64(out[source[ok]] + slot[ok])
            empty = empty[~ok]
        yield 1, rows, out.reshape(len(rows), SLOTS)


def band_keys(kind: int, slots: np.ndarray) -> np.ndarray:
    width = SLOTS // BANDS
    marks = tb.mix64(np.arange(BANDS, dtype=np.uint64) + U(1000 * (kind + 1)))
    out = np.broadcast_to(marks, (len(slots), BANDS)).copy()
    for k in range(width):
        out = tb.mix64(out * U(0x9E3779B97F4A7C15 | 1) + slots[:, k::width])
    return out.view(np.int64)


def sketch_rows(docs: DataFrame, idf: Idf, size: int, id_col: str, text_col: str, names: np.ndarray | None = None, only: bool = False) -> DataFrame:
    """(doc, version, key binary, sketches array<struct<kind, slots, bands>>, held array<int>) of every row.

    ``held`` are the places of those of the sorted ``names`` that are shingles
    of the row; with ``only``, rows without any are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    shared, wanted = (docs.sparkSession.sparkContext.broadcast(x) for x in (idf, np.zeros(0, np.uint64) if names is None else names))
    kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("slots", pa.binary()), ("bands", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            for low, high, data, limits in _chunks(batch.column("text"), 1_000_000):
                n = high - low
                r, h, times, keys = row_shingles(data, limits, size)
                found: list[list[dict]] = [[] for _ in range(n)]
                place = np.searchsorted(wanted.value, h)
                hit = np.flatnonzero(place < len(wanted.value))
                hit = hit[wanted.value[place[hit]] == h[hit]]
                ends = np.searchsorted(r[hit], np.arange(n + 1))
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[hit], pa.int32()))
                if only:
                    stay = np.isin(r, r[hit])
                    r, h, times = r[stay], h[stay], times[stay]
                if len(r):
                    for kind, at, slots in sketches(r, h, (1 + np.log(times)) * shared.value(h), n):
                        small, bands = (slots & U(0xFF)).astype(np.uint8), band_keys(kind, slots)
                        for k, row in enumerate(at.tolist()):
                            found[row].append({"kind": kind, "slots": small[k].tobytes(), "bands": bands[k]})
                raw = keys.astype(">u8").tobytes()
                names = [raw[16 * k : 16 * k + 16] for k in range(n)]
                out = pa.RecordBatch.from_arrays([batch.column("doc").slice(low, n), batch.column("version").slice(low, n), pa.array(names, pa.binary()), pa.array(found, kind_type), held], ["doc", "version", "key", "sketches", "held"])
                yield out.take(pa.array(np.flatnonzero(np.diff(ends)))) if only else out

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, version long, key binary, sketches array<struct<kind:int,slots:binary,bands:array<bigint>>>, held array<int>")


def link_bucket(slots: np.ndarray, like: float, sure: float) -> tuple[list[tuple[int, int]], list[int]]:
    """(links, leaders) of one bucket: few links, which connect all members that are alike.

    A member that no earlier leader resembles for sure leads. The others are
    linked with the leader that they resemble for sure; a leader with the
    earlier leader and with the member that are most like it. Members that are
    alike but not yet connected by these get a link too. Links join what is
    alike into candidate groups; they are no verdict.
    """
    n = len(slots)
    rest, links, leaders = np.ones(n, dtype=bool), [], []
    comp = np.arange(n)
    for k in range(n):
        if not rest[k]:
            continue
        alike = (slots == slots[k]).mean(axis=1)
        alike[k] = 0
        own = len(links)
        if leaders:
            before = leaders[int(alike[leaders].argmax())]
            if alike[before] >= like:
                links.append((k, before))
        links += [(k, int(j)) for j in np.flatnonzero(rest & (alike >= sure))]
        most = int(alike.argmax())
        if alike[most] >= like:
            links.append((k, most))
        if len(links) > own:
            comp[np.isin(comp, comp[[j for _, j in links[own:]]])] = comp[k]
        for j in np.flatnonzero((alike >= like) & (comp != comp[k])).tolist():
            if comp[j] != comp[k]:
                links.append((k, j))
                comp[comp == comp[j]] = comp[k]
        leaders.append(k)
        rest &= alike < sure
        rest[k] = False
    # What is left are members under different leaders.
    led = np.ones(n, dtype=bool)
    led[leaders] = False
    members = np.flatnonzero(led)
    for k in members.tolist():
        other = members[comp[members] != comp[k]]
        if len(other):
            for j in other[(slots[other] == slots[k]).mean(axis=1) >= like].tolist():
                if comp[j] != comp[k]:
                    links.append((k, j))
                    comp[comp == comp[j]] = comp[k]
    return links, leaders


def open_pairs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, x, y, side, key, comp): what two blocks of a label must still compare.

    ``rows`` has (label, block, key), ``labels`` (node, label) the components
    so far. Only members of different components are left to meet; blocks that
    hold one and the same component need no meeting.
    """
    known = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
    several = rows.groupBy("label").agg(F.min("block").alias("p"), F.max("block").alias("q")).where("p <> q").select(F.col("label").alias("g"))
    at = written(rows.join(several, F.col("label") == F.col("g"), "left_semi").join(known, F.col("key") == F.col("n"), "left").select("label", "block", "key", F.coalesce("l", "key").alias("comp")), "open")
    blocks = at.groupBy("label", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = blocks.groupBy("label").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("label")
    blocks = written(blocks.join(mixed, "label", "left_semi"), "blocks")
    named = lambda c: blocks.select("label", *[F.col(v).alias(f"{c}_{v}") for v in ("block", "low", "high")])
    pairs = named("x").join(named("y"), "label").where("x_block < y_block AND NOT (x_low = x_high AND y_low = y_high AND x_low = y_low)")
    side = lambda k, own, other: pairs.select("label", F.col("x_block").alias("x"), F.col("y_block").alias("y"), F.lit(k).alias("side"), F.col(f"{own}_block").alias("block"), F.col(f"{other}_low").alias("low"), F.col(f"{other}_high").alias("high"))
    both = side(0, "x", "y").unionByName(side(1, "y", "x"))
    return at.join(both, ["label", "block"]).where("NOT (low = high AND low = comp)").select("label", "x", "y", "side", "key", "comp")


def meet(comp: np.ndarray, side: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs from side 0 to side 1 that ``near(x, others)`` finds, one for any two components that they join."""
    comp, out = comp.copy(), []
    right = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0).tolist():
        other = right[comp[right] != comp[x]]
        if len(other):
            for y in near(x, other).tolist():
                if comp[y] != comp[x]:
                    out.append((x, y))
                    comp[comp == comp[y]] = comp[x]
    return out


def _meetings(columns: tuple[str, ...], near_of):
    """Arrow function over (label, x, y, side, comp, *columns) sorted by label, x, y: joined components (a, b).

    Two blocks are held at a time. ``near_of(*columns)`` gives their ``near``.
    """

    def run(batches):
        held: list[tuple] = []

        def close():
            names, comp = np.unique(np.array([x[4].hex() for x in held]), return_inverse=True)
            side = np.array([x[3] for x in held])
            found = meet(comp, side, near_of(*zip(*(x[5:] for x in held), strict=True))) if len(names) > 1 and 0 < side.sum() < len(side) else []
            pairs = [(held[i][4], held[j][4]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in range(2)], ["a", "b"])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("label", "x", "y", "side", "comp", *columns)), strict=True):
                if held and x[:3] != held[-1][:3]:
                    yield close()
                    held = []
                held.append(x)
        if held:
            yield close()

    return run


def met(pairs: DataFrame, columns: tuple[str, ...], near_of) -> DataFrame:
    """(a, b): components joined by the meetings of ``pairs``; each meeting of two blocks is work of its own."""
    order = ("label", "x", "y")
    dealt = pairs.select(*order, "side", "comp", *columns).repartition(*order).sortWithinPartitions(*order, "side", "comp")
    return written(dealt.mapInArrow(_meetings(columns, near_of), "a binary, b binary").distinct(), "met")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``edges`` (a, b) between components; a node without a label is its own component."""
    if edges.isEmpty():
        return labels
    top = connected_components(edges)
    moved = labels.join(top.select(F.col("node").alias("n"), F.col("label").alias("l")), F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label"))
    return written(moved.unionByName(top.join(labels.select("node"), "node", "left_anti")), "labels")


_EDGE = "a binary, b binary, bucket long, slots binary, block long, leads boolean"


def _link(like: float, sure: float, borders: bool):
    """Arrow function over (bucket, key, slots) sorted by bucket, key: links, and the members of runs at the borders."""

    def emit(rows):
        types = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["a", "b", "bucket", "slots", "block", "leads"])

    def process(bucket, keys, raw, border):
        out, leaders = [], [0]
        if len(keys) > 1:
            links, leaders = link_bucket(np.frombuffer(b"".join(raw), np.uint8).reshape(len(keys), SLOTS), like, sure)
            out += [(keys[i], keys[j], None, None, None, None) for i, j in links]
        if border:
            from pyspark import TaskContext

            block, lead = TaskContext.get().partitionId(), set(leaders)
            out += [(keys[k], None, bucket, raw[k], block, k in lead) for k in range(len(keys))]
        return out

    def run(batches):
        held: tuple = (None, [], [])
        out, first = [], True
        for batch in batches:
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            if not len(bucket):
                continue
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(bucket))
            last = len(starts) - 1
            # Single documents inside the batch need no work.
            for k in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)).tolist():
                a, b = int(starts[k]), int(ends[k])
                new = [batch.column(c).slice(a, b - a).to_pylist() for c in ("key", "slots")]
                if held[0] is not None and bucket[a] == held[0]:
                    held = (held[0], *[x + y for x, y in zip(held[1:], new, strict=True)])
                else:
                    if held[0] is not None:
                        out += process(*held, borders and first)
                        first = False
                    held = (int(bucket[a]), *new)
            if len(out) > 5000:
                yield emit(out)
                out = []
        if held[0] is not None:
            out += process(*held, borders)
        if out:
            yield emit(out)

    return run


def _alike_of(like: float):
    def near_of(raw):
        slots = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), SLOTS)
        return lambda x, other: other[(slots[other] == slots[x]).mean(axis=1) >= like]

    return near_of


def candidate_groups(reps: DataFrame, like: float = 0.6, sure: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(a, b) links and (node, label) groups of keys that share a bucket and whose sketches are alike.

    Buckets are range-partitioned by (bucket, key), so that a hot bucket is
    spread over several tasks; the leaders at the borders of ranges meet in a
    second, small step. What is still apart then meets run by run.
    """
    rows = reps.select("key", F.inline("sketches")).select("key", "slots", F.explode("bands").alias("bucket"))
    ranged = rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    found = written(ranged.select("bucket", "key", "slots").mapInArrow(_link(like, sure, True), _EDGE), "links")
    runs = found.where(F.col("b").isNull()).select("bucket", F.col("a").alias("key"), "slots", "block", "leads")
    again = runs.where("leads").select("bucket", "key", "slots").repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_link(like, sure, False), _EDGE)
    links = found.where(F.col("b").isNotNull()).select("a", "b").unionByName(again.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    links = written(links, "pairs")
    labels = connected_components(links)
    of_bucket = runs.select(F.col("bucket").alias("label"), "block", "key")
    slots = runs.select(F.col("bucket").alias("label"), "key", "slots").dropDuplicates(["label", "key"])
    return links, joined(labels, met(open_pairs(of_bucket, labels).join(slots, ["label", "key"]), ("slots",), _alike_of(like)))


def exact_near(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, slots: list[np.ndarray], least: float, like: float):
    """near(x, others): those of ``others`` with an exact weighted Jaccard similarity of ``least`` to x.

    ``rows`` are sorted. Members whose sketches are clearly apart are left out.
    """
    n = len(slots)
    total = np.bincount(rows, weights=weights, minlength=n)
    _, ids = np.unique(hashes, return_inverse=True)
    first = np.searchsorted(rows, np.arange(n + 1))
    mark = np.zeros(int(ids.max(initial=-1)) + 1)
    width = 2  # kinds of sketches
    sketch, kinds = np.zeros((n, width, SLOTS), np.uint8), np.zeros((n, width), np.int64)
    for k, own in enumerate(slots):
        for kind, values in own:
            sketch[k, kind], kinds[k, kind] = values, 1

    def near(x: int, other: np.ndarray) -> np.ndarray:
        alike = np.zeros(len(other), dtype=bool)
        for kind in range(width):
            if kinds[x, kind]:
                alike |= (kinds[other, kind] == 1) & ((sketch[other, kind] == sketch[x, kind]).mean(axis=1) >= like)
        other = other[alike]
        if not len(other):
            return other
        mine = slice(first[x], first[x + 1])
        mark[ids[mine]] = weights[mine]
        size = first[other + 1] - first[other]
        at = np.arange(int(size.sum())) + np.repeat(first[other] - (np.cumsum(size) - size), size)
        shared = np.add.reduceat(np.minimum(mark[ids[at]], weights[at]), np.cumsum(size) - size)
        mark[ids[mine]] = 0
        return other[shared >= (least - 1e-9) * (total[x] + total[other] - shared)]

    return near


def exact_classes(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, slots: list[np.ndarray], least: float, like: float) -> np.ndarray:
    """Single-link classes of a block by exact weighted Jaccard similarity: each member's class as its first member.

    From every member the similarity to all members without a class is taken.
    """
    near = exact_near(rows, hashes, weights, slots, least, like)
    n = len(slots)
    cls, free = np.full(n, -1), np.ones(n, dtype=bool)
    for seed in range(n):
        if not free[seed]:
            continue
        cls[seed], free[seed], queue = seed, False, [seed]
        while queue:
            found = near(queue.pop(), np.flatnonzero(free))
            cls[found], free[found] = seed, False
            queue += found.tolist()
    return cls


def _near_texts(idf, size: int, least: float, like: float):
    def near_of(texts, sketches):
        data, limits = tb.string_buffers(pa.array(texts, pa.string()))
        r, h, times, _ = row_shingles(data, limits, size)
        slots = [[(s["kind"], np.frombuffer(s["slots"], np.uint8)) for s in x] for x in sketches]
        return exact_near(r, h, (1 + np.log(times)) * idf.value(h), slots, least, like)

    return near_of


BLOCK_DOCS, BLOCK_BYTES = 4096, 8_000_000
_CLASS = "key binary, rep binary, block long, label binary, text string, sketches array<struct<kind:int,slots:binary>>"


def _block_classes(idf, size: int, least: float, like: float, borders: bool):
    """Arrow function over (label, key, text, sketches) sorted by label, key.

    Gives every key with the first key of its class in the block; the firsts of
    blocks that may go on elsewhere carry their text along, with ``borders``.
    A block is a label's run in the partition, cut at a bound.
    """
    most_docs, most_bytes = BLOCK_DOCS, BLOCK_BYTES
    types = [("key", pa.binary()), ("rep", pa.binary()), ("block", pa.int64()), ("label", pa.binary()), ("text", pa.string()), ("sketches", pa.list_(pa.struct([("kind", pa.int32()), ("slots", pa.binary())])))]

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        held_bytes, opens = 0, True

        def close(goes_on: bool):
            nonlocal held, held_bytes, block, opens
            carry = borders and (goes_on or opens)
            texts = pa.array([x[2] for x in held], pa.string())
            data, limits = tb.string_buffers(texts)
            r, h, times, _ = row_shingles(data, limits, size)
            slots = [[(s["kind"], np.frombuffer(s["slots"], np.uint8)) for s in x[3]] for x in held]
            cls = exact_classes(r, h, (1 + np.log(times)) * idf.value(h), slots, least, like)
            out = []
            for k, x in enumerate(held):
                firsts = carry and cls[k] == k
                out.append((x[1], held[cls[k]][1], block, x[0], x[2] if firsts else None, x[3] if firsts else None))
            block, held, held_bytes, opens = block + 1, [], 0, goes_on
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out, strict=True), types, strict=True)], [c for c, _ in types])

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("label", "key", "text", "sketches")), strict=True):
                if held and x[0] != held[-1][0]:
                    yield close(False)
                elif len(held) >= most_docs or held_bytes > most_bytes:
                    yield close(True)
                held.append(x)
                held_bytes += len(x[2] or "")
        if held:
            yield close(True)

    return run


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: Idf, size: int) -> np.ndarray:
    """Exact similarity of each pair of texts."""
    n = len(left)
    parts = []
    for column in (left, right):
        data, limits = tb.string_buffers(column)
        r, h, times, _ = row_shingles(data, limits, size)
        parts.append((r, h, (1 + np.log(times)) * idf(h)))
    r, h, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((h, r))
    r, h, w = r[order], h[order], w[order]
    total = np.bincount(r, weights=w, minlength=n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    shared = np.bincount(r[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
    return np.where(total > shared, shared / np.maximum(total - shared, 1e-300), 1.0)


def texts_of(docs: DataFrame, reps: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(label, key, text, sketches) of the keys in ``labels`` (node, label)."""
    wanted = reps.join(labels, F.col("key") == F.col("node")).select("label", "key", "doc", "version", "sketches")
    texts = docs.select(F.col(id_col).alias("d"), text_hash(F.col(text_col)).alias("v"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")))
    slim = F.transform("sketches", lambda x: F.struct(x["kind"].alias("kind"), x["slots"].alias("slots")))
    return found.select("label", "key", "text", slim.alias("sketches"))


def verified(texts: DataFrame, links: DataFrame, idf, size: int, least: float) -> DataFrame:
    """(a, b) of the links that reach ``least``."""
    one = texts.select("key", "text")
    pairs = links.join(one.select(F.col("key").alias("a"), F.col("text").alias("left")), "a").join(one.select(F.col("key").alias("b"), F.col("text").alias("right")), "b")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ok = pa.array(np.flatnonzero(weighted_jaccard(part.column("left"), part.column("right"), idf.value, size) >= least - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("a").take(ok), part.column("b").take(ok)], ["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary")


def class_labels(texts: DataFrame, links: DataFrame, idf, size: int, least: float, like: float = 0.6) -> DataFrame:
    """(node, label): the class of every key that has one with others.

    Candidate groups are range-partitioned by (label, key). In a block all
    classes are exact. A group that is cut by a block's bound or by a border is
    joined again by verifying its links between blocks and by taking the
    classes of the blocks' first members; these two only save work. Then every
    two blocks of a group meet, and what is still apart is compared exactly; so
    a group of any size is spread over tasks and no task holds more than two
    blocks.
    """
    columns = ("label", "key", "text", "sketches")
    ranged = texts.repartitionByRange("label", "key").sortWithinPartitions("label", "key").select(*columns)
    local = written(ranged.mapInArrow(_block_classes(idf, size, least, like, True), _CLASS), "classes")
    # The firsts of a label meet in one task, cut into blocks: what they join here need not meet block by block below.
    firsts = local.where(F.col("text").isNotNull()).select(*columns).repartition("label").sortWithinPartitions("label", "key").select(*columns)
    again = firsts.mapInArrow(_block_classes(idf, size, least, like, False), _CLASS)
    at = local.select("key", "block")
    crossing = links.join(at.select(F.col("key").alias("a"), F.col("block").alias("x")), "a").join(at.select(F.col("key").alias("b"), F.col("block").alias("y")), "b").where("x <> y").select("a", "b")
    edges = local.select(F.col("key").alias("a"), F.col("rep").alias("b")).unionByName(again.select(F.col("key").alias("a"), F.col("rep").alias("b")))
    labels = connected_components(edges.unionByName(verified(texts, crossing, idf, size, least)).where(F.col("a") != F.col("b")))
    pairs = open_pairs(local.select("label", "block", "key"), labels).join(texts.select("key", "text", "sketches"), "key")
    return joined(labels, met(pairs, ("text", "sketches"), _near_texts(idf, size, least, like)))


def text_counts(docs: DataFrame, reps: DataFrame, groups: DataFrame, names: np.ndarray, n_docs: int, size: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, counts, n): in how many of the n different texts each common shingle is; a group's least key is its text.

    ``names``, which ``held`` refers to, has all that may be in half a COMMON-th
    of the documents. If fewer than half of them are different texts, that is
    not enough and their shingles are reported and counted anew.
    """
    grouped = reps.select("key", "held").join(groups, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("label", "key").alias("label"))
    firsts = written(grouped.agg(F.min(F.struct("key", "held")).alias("first")).select("first.*"), "firsts")
    n = firsts.count()
    least = max(n / COMMON, FEW)
    if 2 * n >= n_docs:
        rows = firsts.select(F.explode("held").alias("at")).groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()
        return names[[r["at"] for r in rows]], np.array([r["n"] for r in rows], dtype=float), n
    texts = written(texts_of(docs, reps, firsts.select(F.col("key").alias("node"), F.col("key").alias("label")), id_col, text_col).dropDuplicates(["key"]).select("text"), "firsts")
    return *shingle_counts(texts, reported(*shingle_reports(texts, size, "text"), least), size, "text", least), n


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, span: float = SPAN, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, class_doc, class_version, class_size, stays) for every row.

    ``class_doc`` and ``class_version`` name the class by its first member
    (least id, null last, then version); ``stays`` is true for that member.
    ``version`` is the hash of the text.
    """
    parts, n_docs = shingle_reports(docs, size, text_col)
    idf, _ = common_shingles(docs, size, text_col, span, (parts, n_docs))
    names = reported(parts, n_docs, max(n_docs / (2 * COMMON), FEW))
    rows = written(sketch_rows(docs, idf, size, id_col, text_col, names), "sketches")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version")
    reps = written(rows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("rows"), F.first("sketches").alias("sketches"), F.first("held").alias("held")).select("key", "first", "first.doc", "first.version", "rows", "sketches", "held"), "reps")
    links, groups = candidate_groups(reps)
    idf, less = idf.lowered(*text_counts(docs, reps, groups, names, n_docs, size, id_col, text_col), floor)
    if len(less):
        # Only documents with a shingle whose weight fell get other sketches.
        fresh = sketch_rows(docs, idf, size, id_col, text_col, less, only=True).groupBy("key").agg(F.first("sketches").alias("other"))
        reps = written(reps.join(fresh, "key", "left").withColumn("sketches", F.coalesce("other", "sketches")).drop("other", "held"), "reps")
        links, groups = candidate_groups(reps)
    texts = written(texts_of(docs, reps, groups, id_col, text_col).dropDuplicates(["key"]), "texts")
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    labels = class_labels(texts, links, shared, size, least)
    named = reps.select("key", "first", "rows").join(labels, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key"))
    classes = named.groupBy("label").agg(F.min("first").alias("class_first"), F.sum("rows").alias("class_size"))
    of_key = named.select(F.col("key").alias("k"), "label").join(classes, "label").select("k", "class_first", "class_size")
    joined = rows.select("doc", "version", "key").join(of_key, F.col("key") == F.col("k"))
    return joined.select("doc", "version", F.col("class_first.doc").alias("class_doc"), F.col("class_first.version").alias("class_version"), "class_size", (F.col("doc").eqNullSafe(F.col("class_first.doc")) & (F.col("version") == F.col("class_first.version"))).alias("stays"))
