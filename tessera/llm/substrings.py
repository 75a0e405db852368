"""Removal of word passages that an earlier document holds, by suffix automata of reference shards.

The reference of a document is every document with a smaller id. Each window of
``window`` words has an anchor, its least hashed gram of ``GRAM`` words, and
runs of windows with one anchor are a piece. Only anchors that stand in two
documents matter. The different pieces of such anchors, each with the least
document that holds it, are the reference; they are dealt by anchor into shards
of about ``SHARD_WORDS`` words. A suffix automaton is made of each shard, the
shard's pieces are run through it, and the matching statistics say for each
window in which document it stands first. These statistics, not the automata,
travel to the documents: an automaton takes some 380 bytes a word and the
reference grows with the corpus, so whole automata can't be broadcast to all
tasks. A document loses the words of each window that stands first in a
document before it.

An anchor with over ``HOT_WORDS`` words of different pieces has each window as
a piece of its own, so that no shard outgrows a task; the automata decide there
too. ``against`` is for a reference that is a table of its own: its automata
are broadcast, a bounded number of words at a time, and whole documents stream
through them.

Defined results: words are runs of bytes other than space and \\x09-\\x0D; null
text is empty; null ids come after all others and are equal to each other; rows
of one id never take words from each other, rows that repeat id and text each
show the same result; a window that repeats inside one document only stays; an
empty table gives no rows; other columns, whatever their names, are ignored; a
long text is read in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb
from tessera.llm.automaton import NOWHERE, SuffixAutomaton
from tessera.llm.linededup import text_hash
from tessera.llm.storage import read_table, remove_table, write_table, written

GRAM = 5
SHARD_WORDS = 100_000
HOT_WORDS = 400_000
SEGMENT = 1_000_000
_LOW = np.uint64(0xFFFFFFFF)


def place_of(id_column: Column) -> Column:
    """Number by which documents are ordered; null comes last."""
    return F.coalesce(id_column.cast("long"), F.lit(NOWHERE))


def segments(column: pa.Array, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, words before, data, limits) of parts of about ``SEGMENT`` bytes; a longer row comes in parts that share ``window - 1`` words."""
    data, limits = tb.string_buffers(column)
    for low, high in tb.row_chunks(limits, SEGMENT):
        at, end = int(limits[low]), int(limits[high])
        if high - low > 1 or end - at <= 2 * SEGMENT:
            yield low, 0, data[at:end], limits[low : high + 1] - at
            continue
        before, size = 0, SEGMENT
        while True:
            stop = _space_after(data, at + size, end)
            starts, _, _ = tb.word_spans(data[at:stop], np.array([0, stop - at]))
            if stop < end and len(starts) < window:
                size *= 2
                continue
            yield low, before, data[at:stop], np.array([0, stop - at])
            if stop == end:
                break
            before += len(starts) - (window - 1)
            at, size = (at + int(starts[len(starts) - window + 1]) if window > 1 else stop), SEGMENT


def _space_after(data: np.ndarray, at: int, end: int) -> int:
    while at < end:
        found = np.flatnonzero(tb.IS_SPACE[data[at : min(at + 65536, end)]])
        if len(found):
            return at + int(found[0])
        at += 65536
    return end


def pieces(data: np.ndarray, limits: np.ndarray, window: int):
    """(row, first word, number of windows, anchor, hash, first byte, byte after the last) of each piece, in order of place."""
    starts, ends, row = tb.word_spans(data, limits)
    gram = min(GRAM, window)
    m = len(starts) - window + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, none
    words = tb.span_hashes(tb.prefix_hashes(data), starts, ends)
    factors = tb.mix64(np.arange(1, gram + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    g = np.zeros(len(starts) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        g += words[k : k + len(g)] * factors[k]
    g = tb.mix64(g)
    low = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    width, reach = window - gram + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    whole = row[:m] == row[window - 1 :]
    anchor = g[(low & _LOW).astype(np.int64)]
    head = whole.copy()
    head[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (row[1:m] != row[: m - 1])
    at = np.flatnonzero(head)
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none, none
    n = np.add.reduceat(whole.astype(np.int64), at)
    first_word = np.searchsorted(row, row[at])
    last = at + n + window - 2
    return row[at], at - first_word, n, anchor[at], tb.span_hashes(tb.sequence_prefix(words), at, last + 1), starts[at], ends[last]


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(h, ref, place): each anchor of each row of docs (ref, place, text), once in each segment."""

    def run(batches):
        for batch in batches:
            refs, places = batch.column("ref").to_numpy(), batch.column("place").to_numpy()
            for low, _, data, limits in segments(batch.column("text"), window):
                row, _, _, h, _, _, _ = pieces(data, limits, window)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                once = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(row)]
                at = row[once] + low
                yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(refs[at]), pa.array(places[at])], ["h", "ref", "place"])

    return docs.select("ref", "place", "text").mapInArrow(run, "h long, ref long, place long")


def wanted_anchors(anchors: DataFrame) -> DataFrame:
    """(ref, hs): the anchors of each row that stand in two documents or more."""
    ends = anchors.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select(F.col("h").alias("x"))
    # Both sides of the join are tables, so that Spark can split a hot anchor's rows.
    repeated = written(ends, "repeated-anchors")
    return anchors.join(repeated, F.col("h") == F.col("x")).groupBy("ref").agg(F.collect_set("h").alias("hs"))


_PIECE = "h long, p long, ref long, place long, start long, n long, content binary"


def piece_rows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h, p, ref, place, start, n, content): the pieces of wanted anchors; of equal pieces in a batch one has the content, its words joined by a space."""
    joined = docs.join(wanted.withColumnRenamed("ref", "r"), F.col("ref") == F.col("r")).select("ref", "place", "text", "hs")

    def run(batches):
        for batch in batches:
            refs, places, seen = batch.column("ref").to_numpy(), batch.column("place").to_numpy(), set()
            lists = [np.asarray(x.values if x.is_valid else [], dtype=np.int64).view(np.uint64) for x in batch.column("hs")]
            for low, before, data, limits in segments(batch.column("text"), window):
                row, start, n, h, p, begin, end = pieces(data, limits, window)
                keep = np.zeros(len(row), dtype=bool)
                edges = np.searchsorted(row, np.arange(len(limits)))
                for k in range(len(limits) - 1):
                    keep[edges[k] : edges[k + 1]] = np.isin(h[edges[k] : edges[k + 1]], lists[low + k])
                at = np.flatnonzero(keep)
                raw, content = data.tobytes(), []
                for key, a, b in zip(zip(h[at].tolist(), p[at].tolist(), strict=True), begin[at].tolist(), end[at].tolist(), strict=True):
                    content.append(None if key in seen else b" ".join(raw[a:b].split()))
                    seen.add(key)
                row, names = row[at] + low, _PIECE.replace(",", "").split(" ")[::2]
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(p[at].view(np.int64)), pa.array(refs[row]), pa.array(places[row]), pa.array(start[at] + before), pa.array(n[at]), pa.array(content, pa.binary())], names)

    return joined.mapInArrow(run, _PIECE)


def different(pieces_: DataFrame) -> DataFrame:
    """(h, p, place, n, content): each different piece with the least document that holds it."""
    return pieces_.groupBy("h", "p").agg(F.min("place").alias("place"), F.first("n").alias("n"), F.max("content").alias("content"))


def shard_statistics(reference: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(h, p, runs): for each piece runs of windows (at, n) that stand first in document ``first``.

    Pieces meet by anchor; a shard is a run of anchors, its automaton lives in one task.
    """
    run_type = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("first", pa.int64())]))

    def statistics(shard: list[tuple[int, int, int, bytes]]):
        names: dict[bytes, int] = {}
        texts = [[names.setdefault(w, len(names)) for w in content.split(b" ")] for _, _, _, content in shard]
        automaton = SuffixAutomaton()
        for (_, _, place, _), symbols in zip(shard, texts, strict=True):
            automaton.add(symbols, place)
        automaton.close()
        hs, ps, runs = [], [], []
        for (h, p, _, _), symbols in zip(shard, texts, strict=True):
            first = automaton.matching(symbols, window)[window - 1 :]
            mine: list[dict] = []
            for k, x in enumerate(first):
                if mine and mine[-1]["first"] == x:
                    mine[-1]["n"] += 1
                else:
                    mine.append({"at": k, "n": 1, "first": x})
            hs.append(h)
            ps.append(p)
            runs.append(mine)
        return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ps, pa.int64()), pa.array(runs, run_type)], ["h", "p", "runs"])

    def run(batches):
        shard: list[tuple[int, int, int, bytes]] = []
        size, at = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "p", "place", "content")), strict=True):
                if size >= shard_words and row[0] != at:
                    yield statistics(shard)
                    shard, size = [], 0
                at = row[0]
                size += row[3].count(b" ") + 1
                shard.append(row)
        if shard:
            yield statistics(shard)

    dealt = reference.select("h", "p", "place", "content").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "h long, p long, runs array<struct<at:bigint,n:bigint,first:bigint>>")


def window_pieces(reference: DataFrame, window: int) -> DataFrame:
    """Every window of the pieces as a piece of its own under its own hash: (h, p, place, n, content, old_h, old_p, at)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for h, p, place, content in zip(*(batch.column(c).to_pylist() for c in ("h", "p", "place", "content")), strict=True):
                words = content.split(b" ")
                for at in range(len(words) - window + 1):
                    text = b" ".join(words[at : at + window])
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    for column, value in zip(out, (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), place, 1, text, h, p, at), strict=True):
                        column.append(value)
            types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["h", "p", "place", "n", "content", "old_h", "old_p", "at"])

    return reference.select("h", "p", "place", "content").mapInArrow(run, "h long, p long, place long, n long, content binary, old_h long, old_p long, at long")


def first_documents(reference: DataFrame, window: int, shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """As ``shard_statistics``, whatever the size of an anchor."""
    heavy = reference.groupBy("h").agg(F.sum(F.col("n") + window - 1).alias("words")).where(F.col("words") > hot_words).select(F.col("h").alias("x"))
    hot = written(heavy, "hot-anchors")
    if hot.isEmpty():
        return shard_statistics(reference, window, shard_words)
    plain = shard_statistics(reference.join(hot, F.col("h") == F.col("x"), "left_anti"), window, shard_words)
    single = written(window_pieces(reference.join(hot, F.col("h") == F.col("x"), "left_semi"), window), "window-pieces")
    found = written(shard_statistics(different(single), window, shard_words), "window-statistics").select(F.col("h").alias("y"), F.col("p").alias("q"), F.get("runs", F.lit(0))["first"].alias("first"))
    met = single.join(found, (F.col("h") == F.col("y")) & (F.col("p") == F.col("q")))
    runs = met.groupBy("old_h", "old_p").agg(F.array_sort(F.collect_list(F.struct("at", F.lit(1).cast("long").alias("n"), "first"))).alias("runs"))
    return plain.unionByName(runs.select(F.col("old_h").alias("h"), F.col("old_p").alias("p"), "runs"))


def removed_runs(pieces_: DataFrame, statistics: DataFrame) -> DataFrame:
    """(ref, gone): runs of windows (start, n) of each row that stand first in a document before it."""
    s = statistics.select(F.col("h").alias("y"), F.col("p").alias("q"), "runs")
    met = pieces_.select("h", "p", "ref", "place", "start").join(s, (F.col("h") == F.col("y")) & (F.col("p") == F.col("q")))
    early = F.filter("runs", lambda x: x["first"] < F.col("place"))
    gone = F.transform(early, lambda x: F.struct((F.col("start") + x["at"]).alias("start"), x["n"].alias("n")))
    return met.select("ref", gone.alias("gone")).where(F.size("gone") > 0).groupBy("ref").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def covered(n_words: int, runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows that start in the given runs."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        a, b = start, min(n_words, start + n + window - 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_words(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(doc, version, n_words, n_removed, kept_sha256, spans) and with ``with_text`` kept, of docs (doc, version, text, gone)."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for raw, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words = raw.split()
                spans = covered(len(words), [(x["start"], x["n"]) for x in runs or []], window)
                left, at = [], 0
                for a, b in spans:
                    left += words[at:a]
                    at = b
                left += words[at:]
                kept = b" ".join(left)
                out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept.decode() if with_text else ""))
            columns = (list(zip(*out, strict=True)) if out else [()] * 5)[: len(names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), *[pa.array(x, t) for x, t in zip(columns, types, strict=False)]], ["doc", "version", *names])

    names, types = ["n_words", "n_removed", "kept_sha256", "spans", "kept"][: 5 if with_text else 4], [pa.int64(), pa.int64(), pa.string(), span_type, pa.string()]
    schema = f"doc {kind}, version long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return docs.select("doc", "version", "text", "gone").mapInArrow(run, schema + (", kept string" if with_text else ""))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, version = F.col(id_col), text_hash(F.col(text_col))
    return docs.select(doc.alias("doc"), version.alias("version"), F.xxhash64(doc, version).alias("ref"), place_of(doc).alias("place"), F.coalesce(text_col, F.lit("")).alias("text"))


def dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS, with_text: bool = False) -> DataFrame:
    """(doc, version, n_words, n_removed, kept_sha256, spans) of every row; spans are word positions.

    With ``with_text`` also ``kept``, the words left, joined by a space.
    """
    spark = docs.sparkSession
    table = _prepared(docs, id_col, text_col)
    rows = anchor_rows(table, window)
    path = write_table(rows, "anchors")
    wanted = written(wanted_anchors(read_table(rows, path)), "wanted")
    remove_table(spark, path)
    met = written(piece_rows(table, wanted, window), "pieces")
    reference = written(different(met), "reference")
    statistics = written(first_documents(reference, window, shard_words, hot_words), "statistics")
    gone = removed_runs(met, statistics).withColumnRenamed("ref", "r")
    return cut_words(table.join(gone, F.col("ref") == F.col("r"), "left"), window, with_text)


def against(docs: DataFrame, reference: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", reference_text: str = "text", round_words: int = 2_000_000, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """As ``dedup``, for the windows that stand anywhere in ``reference``, a table of its own.

    The reference is cut into shards; in each round the shards of at most
    ``round_words`` words are broadcast and every document streams through an
    automaton of each. Rounds grow with the reference, so this is for one that
    is small beside the documents, such as benchmark texts.
    """
    spark = docs.sparkSession
    table = _prepared(docs, id_col, text_col)
    known = reference.select(F.coalesce(reference_text, F.lit("")).alias("t")).distinct()
    counted = written(known.withColumns({"size": F.size(F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"), "key": F.xxhash64("t")}).where(F.col("size") >= window), "known")
    total = counted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rounds = max(1, -(-total // round_words))
    found = None
    for turn in range(rounds):
        texts = [r["t"].encode() for r in counted.where(F.pmod("key", F.lit(rounds)) == turn).select("t").toLocalIterator()]
        shared = spark.sparkContext.broadcast(texts)

        def run(batches, shared=shared):
            names: dict[bytes, int] = {}
            shards, automaton, size = [], SuffixAutomaton(), 0
            for text in shared.value:
                symbols = [names.setdefault(w, len(names)) for w in text.split()]
                if size and size + len(symbols) > shard_words:
                    automaton.close()
                    shards.append(automaton)
                    automaton, size = SuffixAutomaton(), 0
                automaton.add(symbols, 0)
                size += len(symbols)
            automaton.close()
            shards.append(automaton)
            for batch in batches:
                gone = []
                for raw in batch.column("text").cast(pa.binary()).to_pylist():
                    symbols = [names.get(w) for w in raw.split()]
                    hits = sorted({k for a in shards for k, x in enumerate(a.matching(symbols, window)) if x != NOWHERE})
                    gone.append([{"start": k - window + 1, "n": 1} for k in hits])
                yield pa.RecordBatch.from_arrays([batch.column("ref"), pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))], ["ref", "gone"])

        met = table.select("ref", "text").mapInArrow(run, "ref long, gone array<struct<start:bigint,n:bigint>>").where(F.size("gone") > 0)
        found = met if found is None else found.unionByName(met)
    gone = found.groupBy("ref").agg(F.flatten(F.collect_list("gone")).alias("gone")).withColumnRenamed("ref", "r")
    return cut_words(table.join(gone, F.col("ref") == F.col("r"), "left"), window, with_text)
