"""Exact duplicate passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every 100-byte string of the corpus has an anchor, the least hashed 40-byte
gram in it; equal strings have equal anchors. Consecutive strings with one
anchor form a piece of text, cut at ``MOST_STRINGS``. Pieces whose anchor occurs
once cannot hold a repeated string. The others meet by anchor, where identical
pieces are first folded into their earliest occurrence (also before they are
shuffled, which keeps hot passages small). Over the different pieces of an
anchor a Burrows-Wheeler transform is made, and common prefixes of neighbouring
suffixes are derived by increasing value: starting from the empty string,
intervals are extended backward breadth-first, each right border is given the
length at which it first appears, and the expansion stops at the minimum
length. Borders that are still open join suffixes with an equal prefix of that
length; of such a class all strings but the earliest are removed. An anchor
with more than ``HOT_BYTES`` of different pieces is dealt string by string, by
the string's own hash, so that no task holds it all.

Defined results: null text is empty; documents are ordered by id, null last,
then by the text's hash; rows that repeat id and text are one document, and
each shows its result; texts shorter than the minimum lose nothing; an empty
table gives no rows; other columns, whatever their names, are ignored; a text
of any length is read in overlapping segments, and one that repeats itself
keeps the first occurrence of each string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb
from tessera.llm.linededup import text_hash
from tessera.llm.storage import remove_table, write_table, written

GRAM = 40
_LOW = np.uint64(0xFFFFFFFF)
_BWT_SYMBOLS = 1_500_000
MOST_STRINGS = 2048  # strings in a piece
HOT_BYTES = 2_000_000  # different pieces of an anchor that one task takes
SEGMENT = 1_000_000
_FLUSH = 50_000  # pieces that a worker holds before it hands them on


def anchor_runs(data: np.ndarray, limits: np.ndarray, length: int):
    """(first string start, number of strings, row, anchor hash, piece hash, anchor moves) of each piece, in order of place.

    Where the anchor's gram stands at several places, strings of one piece may be equal.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    m = n - GRAM + 1
    at = np.arange(m)
    prefix = tb.prefix_hashes(data)
    g = tb.span_hashes(prefix, at, at + GRAM)
    low = (g & ~_LOW) | at.astype(np.uint64)
    width, reach = length - GRAM + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    sizes = np.diff(limits)
    rows = np.flatnonzero(sizes >= length)
    per_row = sizes[rows] - length + 1
    if not len(rows):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    total = int(per_row.sum())
    first = np.cumsum(per_row) - per_row
    starts = np.arange(total) + np.repeat(limits[rows] - first, per_row)
    spot = (low[starts] & _LOW).astype(np.int64)
    anchor = g[spot]
    head = np.ones(total, dtype=bool)
    head[1:] = anchor[1:] != anchor[:-1]
    head[first] = True
    runs = np.flatnonzero(head)
    size = np.diff(np.append(runs, total))
    if len(size) and size.max() > MOST_STRINGS:  # a text of one period of up to 60 bytes is one run
        head |= (np.arange(total) - np.repeat(runs, size)) % MOST_STRINGS == 0
        runs = np.flatnonzero(head)
        size = np.diff(np.append(runs, total))
    begin = starts[runs]
    moved = np.append(False, spot[1:] != spot[:-1]) & ~head
    return begin, size, np.repeat(rows, per_row)[runs], anchor[runs], tb.span_hashes(prefix, begin, begin + size + length - 1), np.logical_or.reduceat(moved, runs)


def _segments(column: pa.Array, length: int):
    """(first row, row after the last, offset in the first row, data, limits) of parts of about ``SEGMENT`` bytes.

    A longer row comes in parts of its own that overlap, so that each string stands whole in one.
    """
    data, limits = tb.string_buffers(column)
    for low, high in tb.row_chunks(limits, SEGMENT):
        begin, end = int(limits[low]), int(limits[high])
        if end - begin <= 2 * SEGMENT:
            yield low, high, 0, data[begin:end], limits[low : high + 1] - begin
            continue
        for at in range(begin, end - length + 1, SEGMENT):
            stop = min(at + SEGMENT + length - 1, end)
            yield low, high, at - begin, data[at:stop], np.array([0, stop - at])


def repeated_classes(pieces: list[bytes], starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, class) of each string of ``length`` that has an equal one among ``pieces``.

    ``starts`` is the number of strings in each piece. The classes come from
    the open borders of the expansion.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.zeros(int(sizes.sum()) + len(pieces), dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), dtype=bool)
    inside[first + sizes] = False
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    order = suffix_order(text, length)
    bwt = text[order - 1]
    closed = closed_borders(bwt, length)
    group = np.cumsum(closed[:-1]) - 1
    place = np.full(len(text), -1, dtype=np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(len(text)) - first[owner]
    starts_here = offset < starts[owner]
    place[order] = group
    p = np.flatnonzero(starts_here)
    cls = place[p]
    _, back, times = np.unique(cls, return_inverse=True, return_counts=True)
    many = times[back] > 1
    p = p[many]
    return owner[p], offset[p], cls[many]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols or more, by prefix doubling."""
    n = len(text)
    packed, reach = np.zeros(n, dtype=np.int64), 7
    for k in range(reach):
        packed[: n - k] |= text[k:] << (9 * (reach - 1 - k)) if k < n else 0
    order = np.argsort(packed, kind="stable")
    while True:
        ordered = packed[order]
        step = np.ones(n, dtype=np.int64)
        step[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        if reach > depth or rank[order[-1]] == n:
            return order
        packed = rank << 32
        packed[: n - reach] |= rank[reach:]
        order = np.argsort(packed, kind="stable")
        reach *= 2


def closed_borders(bwt: np.ndarray, length: int) -> np.ndarray:
    """True at i where the suffixes i-1 and i have a common prefix shorter than ``length``.

    Symbol 0 parts the pieces; no interval is extended by it.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)  # backward step of each place
    step[by_symbol] = np.arange(n)
    same = np.zeros(n, dtype=bool)
    same[1:] = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, after = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
    before[by_symbol[1:][same[1:]]] = by_symbol[:-1][same[1:]]
    after[by_symbol[:-1][same[1:]]] = by_symbol[1:][same[1:]]
    closed = np.zeros(n + 1, dtype=bool)
    closed[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    real = bwt != 0
    for _ in range(length):
        size = high - low
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        left, right = np.repeat(low, size), np.repeat(high, size)
        usable = real[at]
        firsts, lasts = at[usable & (before[at] < left)], at[usable & (after[at] >= right)]
        new_low, new_high = np.sort(step[firsts]), np.sort(step[lasts]) + 1
        fresh = ~closed[new_high]
        low, high = new_low[fresh], new_high[fresh]
        closed[high] = True
        if not len(low):
            break
    return closed


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, ref, here, size): each anchor once for each batch of rows, and with ``here`` each place where it repeats in the batch.

    ``size``, on one row of a batch's anchor, is the length of its different pieces there.
    """

    def run(batches):
        for batch in batches:
            refs, parts = batch.column("ref").to_numpy(), []
            for low, _, _, data, limits in _segments(batch.column("text"), length):
                _, n, row, h, w, moves = anchor_runs(data, limits, length)
                parts.append((h, w, row + low, n + length - 1, moves))
            if not parts:
                continue
            h, w, row, n, moves = (np.concatenate([p[k] for p in parts]) for k in range(5))
            order = np.lexsort((w, h))
            h, w, row, n, moves = h[order], w[order], row[order], n[order], moves[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = h[1:] != h[:-1]
            fresh = first.copy()
            fresh[1:] |= w[1:] != w[:-1]
            heads = np.flatnonzero(first)
            size = np.zeros(len(h), dtype=np.int64)
            if len(h):
                size[heads] = np.add.reduceat(np.where(fresh, n, 0), heads)
            again = ~first | moves
            again[:-1] |= ~first[1:]
            # The first place stands for the batch; all places of a repeated anchor are known to repeat.
            for mask, here in ((first & ~again, False), (again, True)):
                at = np.flatnonzero(mask)
                if here:  # a document once for each of its repeated anchors
                    at = at[np.lexsort((-size[at], row[at], h[at]))]
                    at = at[np.append(True, (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1]))[: len(at)]]
                at = at[np.argsort(row[at], kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(refs[row[at]]), pa.array(np.full(len(at), here)), pa.array(size[at])], ["h", "ref", "here", "size"])

    return docs.select("ref", "text").mapInArrow(run, "h long, ref long, here boolean, size long")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(ref, h, hot): anchors that occur twice or more, with the documents that hold them.

    A row without ``ref`` and with ``hot`` names an anchor with over ``HOT_BYTES`` of pieces.
    """
    here = rows.where("here").select("ref", "h", F.lit(False).alias("hot"))
    known = rows.where("here").groupBy("h").agg(F.sum("size").alias("size")).select("h", F.lit(None).cast("long").alias("ref"), "size")
    single = rows.where("not here").select("h", "ref", "size").unionByName(known)
    # One row for each batch at most, so no anchor is hot here.
    sorted_rows = single.repartition("h").sortWithinPartitions("h")
    hot_bytes = HOT_BYTES

    def run(batches):
        held_h, held_ref, open_run, total = None, None, False, 0
        out = lambda h, ref, hot: pa.RecordBatch.from_arrays([h, ref, hot], ["h", "ref", "hot"])

        def named(hs: list[int]):
            return out(pa.array(hs, pa.int64()), pa.nulls(len(hs), pa.int64()), pa.array([True] * len(hs), pa.bool_()))

        for batch in batches:
            h, ref, size = batch.column("h").to_numpy(), batch.column("ref"), batch.column("size").to_numpy()
            if not len(h):
                continue
            same = np.zeros(len(h) + 1, dtype=bool)
            same[1:-1] = h[1:] == h[:-1]
            same[0] = held_h is not None and h[0] == held_h
            out_h, out_ref = [], []
            if same[0] and not open_run:
                out_h.append([held_h])
                out_ref.append(pa.array([held_ref], pa.int64()))
            keep = np.flatnonzero(same[:-1] | same[1:])
            out_h.append(h[keep])
            out_ref.append(ref.take(pa.array(keep)))
            n = sum(map(len, out_h))
            yield out(pa.array(np.concatenate(out_h).astype(np.int64)), pa.concat_arrays(out_ref), pa.array(np.zeros(n, dtype=bool)))
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            sums = np.add.reduceat(size, heads)
            hot = []
            if same[0]:
                sums[0] += total
            elif total > hot_bytes:
                hot.append(held_h)
            hot += h[heads[:-1]][sums[:-1] > hot_bytes].tolist()
            if hot:
                yield named(hot)
            held_h, held_ref, open_run, total = int(h[-1]), ref[len(h) - 1].as_py(), bool(same[-2]), int(sums[-1])
        if total > hot_bytes:
            yield named([held_h])

    return sorted_rows.mapInArrow(run, "h long, ref long, hot boolean").where("ref IS NOT NULL OR hot").select("ref", "h", "hot").unionByName(here)


_PIECE = [("h", pa.int64()), ("doc", None), ("version", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("moves", pa.bool_())]


def pieces_of(docs: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """(h, doc, version, start, n, content, moves): pieces of repeated anchors; content null: known to be removed.

    Of identical pieces that are held at once only the earliest keeps its
    content. Pieces of a hot anchor come as their strings, each under its own hash.
    """
    hot = repeated.where("hot").select(F.col("h").alias("x")).distinct()
    wanted = repeated.where("ref IS NOT NULL").join(hot, F.col("h") == F.col("x"), "left")
    asked = wanted.groupBy("ref").agg(F.collect_list("h").alias("hs"), F.collect_list("x").alias("hots")).withColumnRenamed("ref", "r")
    joined = docs.join(asked, F.col("ref") == F.col("r")).select("doc", "version", "text", "hs", "hots")
    kind = joined.schema["doc"].dataType.simpleString()

    def run(batches):
        mark = lambda x, r: tb.mix64(x ^ tb.mix64(r.astype(np.uint64) + np.uint64(1)))

        def among(h, row, lists: pa.Array):
            values = np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64)
            counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            return np.isin(mark(h, row), mark(values, np.repeat(np.arange(len(lists)), counts)))

        for batch in batches:
            docs_, versions = batch.column("doc").to_pylist(), batch.column("version").to_pylist()
            rows, gone, seen = [], [], {}

            def drop(doc, version, start, n):
                last = gone[-1] if gone else None  # noqa: B023
                if last and last[1] == doc and last[2] == version and last[3] + last[4] == start:
                    last[4] += n
                else:
                    gone.append([None, doc, version, start, n, None, False])  # noqa: B023

            def add(mine):
                other = seen.setdefault(mine[5], len(rows))  # noqa: B023
                if other == len(rows):  # noqa: B023
                    rows.append(mine)  # noqa: B023
                    return
                theirs = rows[other]  # noqa: B023
                a, b = _place(mine), _place(theirs)
                if a == b:
                    return
                if a < b:
                    rows[other], mine = mine, theirs  # noqa: B023
                drop(*mine[1:5])

            for low, high, off, data, limits in _segments(batch.column("text"), length):
                start, n, row, h, _, moves = anchor_runs(data, limits, length)
                ok = np.flatnonzero(among(h, row, batch.column("hs").slice(low, high - low)))
                hots = among(h[ok], row[ok], batch.column("hots").slice(low, high - low))
                raw = data.tobytes()
                for s, k, r, x, apart, move in zip(start[ok].tolist(), n[ok].tolist(), row[ok].tolist(), h[ok].view(np.int64).tolist(), hots.tolist(), moves[ok].tolist(), strict=True):
                    doc, version, at = docs_[low + r], versions[low + r], s - int(limits[r]) + off
                    if not apart:
                        add((x, doc, version, at, k, raw[s : s + k + length - 1], move))
                        continue
                    for i in range(k):
                        one = raw[s + i : s + i + length]
                        add((int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "big", signed=True), doc, version, at + i, 1, one, False))
                if len(rows) + len(gone) > _FLUSH:
                    yield _piece_batch(rows + gone, batch.schema.field("doc").type)
                    rows, gone, seen = [], [], {}
            yield _piece_batch(rows + gone, batch.schema.field("doc").type)

    return joined.mapInArrow(run, f"h long, doc {kind}, version long, start long, n long, content binary, moves boolean")


def _place(row: tuple) -> tuple:
    return (row[1] is None, row[1] if row[1] is not None else 0, row[2], row[3])


def _piece_batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, t or doc_type) for x, (_, t) in zip(columns, _PIECE, strict=True)], [c for c, _ in _PIECE])


def removals(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, version, start, n): runs of string starts whose strings occur earlier."""
    kind = pieces.schema["doc"].dataType.simpleString()
    done = pieces.where(F.col("content").isNull()).select("doc", "version", "start", "n")

    def expand(groups: list[list[tuple]]):
        """Removal rows of a set of anchors, each with its different pieces."""
        flat = [p for g in groups for p in g]
        places = sorted({_place(p)[:3] for p in flat})
        rank = {x: k for k, x in enumerate(places)}
        base = np.array([rank[_place(p)[:3]] << 34 | p[3] for p in flat], dtype=np.int64)
        owner, offset, cls = repeated_classes([p[5] for p in flat], np.array([p[4] for p in flat]), length)
        at = base[owner] + offset
        order = np.lexsort((at, cls))
        late = np.zeros(len(order), dtype=bool)
        late[1:] = cls[order][1:] == cls[order][:-1]
        late &= np.append(False, at[order][1:] != at[order][:-1])
        hit = order[late]
        o, s = owner[hit], offset[hit]
        by = np.lexsort((s, o))
        o, s = o[by], s[by]
        head = np.ones(len(o), dtype=bool)
        head[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
        runs = np.flatnonzero(head)
        for k, m in zip(runs.tolist(), np.diff(np.append(runs, len(o))).tolist(), strict=True):
            p = flat[o[k]]
            yield (p[1], p[2], p[3] + int(s[k]), m)

    def run(batches):
        doc_type, held, groups, size, out = None, {}, [], 0, []
        at = None

        def close():
            nonlocal size
            if len(held) > 1 or any(x[6] for x in held.values()):
                groups.append(list(held.values()))
                size += sum(len(c) + 1 for c in held)

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (doc_type, pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc", "version", "start", "n"])

        for batch in batches:
            doc_type = batch.schema.field("doc").type
            h = batch.column("h").to_numpy()
            if len(h) > 1:  # an anchor with one piece left, all of it in this batch, needs no work
                same = h[1:] == h[:-1]
                busy = np.append(same, True) | np.append(True, same) | batch.column("moves").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(busy))
            for row in zip(*(batch.column(c).to_pylist() for c, _ in _PIECE), strict=True):
                if row[0] != at:
                    close()
                    held, at = {}, row[0]
                    if size >= _BWT_SYMBOLS:
                        out += expand(groups)
                        groups, size = [], 0
                other = held.setdefault(row[5], row)
                if other is not row:
                    a, b = _place(row), _place(other)
                    if a < b:
                        held[row[5]], row = row, other
                    if a != b:
                        out.append((row[1], row[2], row[3], row[4]))
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        close()
        if groups:
            out += expand(groups)
        if out:
            yield batch_of(out)

    ranged = pieces.where(F.col("content").isNotNull()).repartition("h").sortWithinPartitions("h")
    return ranged.mapInArrow(run, f"doc {kind}, version long, start long, n long").unionByName(done)


def merged_spans(starts: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the strings that start in the given runs."""
    out: list[list[int]] = []
    for k in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[k]), int(starts[k] + counts[k] - 1 + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc, version, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start,end>>) of every row.

    With ``with_text`` also ``kept`` binary, the bytes that are left.
    """
    doc, version = F.col(id_col), text_hash(F.col(text_col))
    table = docs.select(doc.alias("doc"), version.alias("version"), F.xxhash64(doc, version).alias("ref"), F.coalesce(text_col, F.lit("")).alias("text"))
    anchors = write_table(anchor_rows(table, length), "anchors")
    wanted = written(repeated_anchors(docs.sparkSession.read.schema("h long, ref long, here boolean, size long").parquet(anchors)), "repeated")
    remove_table(docs.sparkSession, anchors)
    gone = removals(pieces_of(table, wanted, length), length)
    lists = gone.groupBy(F.xxhash64("doc", "version").alias("r")).agg(F.collect_list(F.struct("doc", "version", "start", "n")).alias("gone"))
    joined = table.join(lists, F.col("ref") == F.col("r"), "left").select("doc", "version", "text", "gone")
    kind = joined.schema["doc"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for d, v, raw, gone_ in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(), texts, batch.column("gone").to_pylist(), strict=True):
                own = [x for x in gone_ or [] if x["doc"] == d and x["version"] == v]
                spans = merged_spans(np.array([x["start"] for x in own], dtype=np.int64), np.array([x["n"] for x in own], dtype=np.int64), length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                row = (d, v, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans])
                out.append((*row, left) if with_text else row)
            types = [batch.schema.field("doc").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.binary()]
            names = ["doc", "version", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            m = 8 if with_text else 7
            columns = list(zip(*out, strict=True)) if out else [()] * m
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types[:m], strict=True)], names[:m])

    schema = f"doc {kind}, version long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(run, schema + (", kept binary" if with_text else ""))
