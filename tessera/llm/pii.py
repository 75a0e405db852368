"""Personal data: fixed patterns, secrets, and terms that give protected entities away.

Base spans (e-mail, IP, card, phone) come from fixed patterns; secrets are long
runs of letters and digits whose characters carry much information. Protected
entities are each such value, and each kind as a class. The corpus then says
how strongly a term reveals an entity: for term t and entity e, P(e|t) is the
share of t's documents that hold e, and log2(P(e|t) / P(e)) the information
that t discloses. What a pair has been seen often enough for is itself measured
in bits: its contexts times the divergence of P(e|t) from P(e), against the
bits that the best of all terms reaches by chance. Contexts are different texts
for a value and different values for a class. Terms over the thresholds add
spans wherever they stand, in all documents: terms that disclose most are
removed, the others generalised.

Defined results: null text counts as empty and has no spans; rows with the
same id and text share their added spans; copies of one text are one context,
but each counts as a document; pairs exactly at a threshold pass; an empty
table gives no rows; ids may be null; other columns, whatever their names, are
ignored; texts of any length are searched whole, in time linear in their length.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbatch as tb
from tessera.llm.linededup import text_hash
from tessera.llm.storage import written

# The base patterns, in the order in which kinds are listed.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

# The first two in parts: searched as they stand they take the square of a long run's length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")
_RUN = re.compile(r"[A-Za-z0-9_+=]{20,}")
SECRET_BITS = 3.0  # information of a secret's mean character, by the run's own shares
_FOLD = np.zeros(256, dtype=np.uint8)
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_b] = _b + 32
_FOLD[0x80:] = np.arange(0x80, 0x100)
_MARKS = 24  # bits of a slot in the bitmap of telling terms
_WIDE = 1000  # a term in over 1 / _WIDE of all documents may be left out of the pairs


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email_spans(text: str):
    """Matches of EMAIL: the characters before each @, as far back as the last match, with the domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def ip_spans(text: str):
    """Matches of IP: each four parts of a dotted run, from its start; parts at most 255."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() >= 7:
            parts, start = run.group().split("."), run.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield start, end
                start = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in email_spans(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in ip_spans(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def char_bits(run: str) -> float:
    """Mean information of a character of ``run`` in bits, by the shares of its own characters."""
    shares = np.unique(np.frombuffer(run.encode(), np.uint8), return_counts=True)[1] / len(run)
    return float(-(shares * np.log2(shares)).sum())


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """("secret", start, end) of runs with letters and digits that carry ``SECRET_BITS`` a character, clear of base spans."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if _DIGIT.search(run) and _LETTER.search(run) and char_bits(run) >= SECRET_BITS and not any(a < m.end() and m.start() < b for _, a, b in base):
            out.append(("secret", m.start(), m.end()))
    return out


def entity_of(kind: str, value: str) -> str:
    """One name for all spellings of an entity."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip', 'secret') else re.sub('[^0-9]', '', value)}"


def protected(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and secret spans."""
    base = base_spans(text)
    return base, secret_spans(text, base)


def _terms(data: np.ndarray, limits: np.ndarray):
    """(rows, starts, ends, hashes) of all terms; A-Z lower-cased, positions in bytes."""
    folded = _FOLD[data]
    starts, ends, rows = tb.word_spans(np.where(folded == 0, np.uint8(32), folded), limits)
    return rows, starts, ends, tb.span_hashes(tb.prefix_hashes(folded), starts, ends)


def _outside(data: np.ndarray, limits: np.ndarray, rows, starts, ends, spans: list[list[tuple[str, int, int]]]):
    """(outside of all spans of its row, start, end) of each term, in code points of its row."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = chars[limits]
    cover = np.zeros(int(chars[-1]) + 1, dtype=np.int32)
    for k, own in enumerate(spans):
        for _, s, e in own:
            cover[first[k] + s] += 1
            cover[first[k] + e] -= 1
    taken = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    s, e = chars[starts], chars[ends]
    return taken[e] == taken[s], s - first[rows], e - first[rows]


def _parts(column: pa.Array, most: int = 2_000_000):
    data, limits = tb.string_buffers(column)
    for low, high in tb.row_chunks(limits, most):
        yield low, high, data[limits[low] : limits[high]], limits[low : high + 1] - limits[low]


def _distinct(rows: np.ndarray, h: np.ndarray):
    """(rows, hashes) without repeats, by row."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[fresh], h[fresh]


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, n_email, n_ip, n_card, n_phone, base string, secrets array, entities array, terms array) for every row.

    ``entities`` has a row's different values; ``terms`` the hashes of its
    distinct terms outside of its spans, if it has an entity.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("version"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        for batch in batches:
            counts, bases, secrets, found, entities, terms = {k: [] for k in KINDS}, [], [], [], [], []
            for text in batch.column("text").to_pylist():
                spans, hidden = protected(text or "")
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in spans))
                bases.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                secrets.append([{"start": s, "end": e} for _, s, e in hidden])
                found.append(spans + hidden)
                entities.append(sorted({entity_of(k, text[s:e]) for k, s, e in found[-1]}))
            has = np.flatnonzero([len(x) > 0 for x in found])
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for low, high, data, limits in _parts(batch.column("text").take(pa.array(has))):
                r, starts, ends, h = _terms(data, limits)
                free, _, _ = _outside(data, limits, r, starts, ends, [found[k] for k in has[low:high]])
                r, h = _distinct(r[free], h[free])
                sizes[has[low:high]] = np.bincount(r, minlength=high - low)
                terms.append(h.view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *terms])))
            columns = [batch.column("doc"), batch.column("version"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(bases, pa.string()), pa.array(secrets, pa.list_(span)), pa.array(entities, pa.list_(pa.string())), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "version", *[f"n_{k}" for k in KINDS], "base", "secrets", "entities", "terms"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, version long, n_email long, n_ip long, n_card long, n_phone long, base string, secrets array<struct<start:int,end:int>>, entities array<string>, terms array<long>")


def held_entities(found: DataFrame) -> DataFrame:
    """(version, terms, holds array<struct<entity, context>>) of rows with an entity.

    Each value is an entity, seen in the context of its text. Each kind is one
    too; its context is the least of the row's values of that kind, so that
    copies and variants around one value say it once.
    """
    values = F.transform("entities", lambda x: F.struct(F.xxhash64(x).alias("entity"), F.col("version").alias("context")))
    own = lambda kind: F.filter("entities", lambda x: x.startswith(f"{kind}:"))
    classes = F.array(*[F.when(F.size(own(k)) > 0, F.struct(F.xxhash64(F.lit(f"any:{k}")).alias("entity"), F.xxhash64(F.array_min(own(k))).alias("context"))) for k in (*KINDS, "secret")])
    return found.where(F.size("entities") > 0).select("version", "terms", F.concat(values, F.array_compact(classes)).alias("holds"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term_hash, n_docs): in how many documents each term stands; all terms of all texts."""

    def run(batches):
        for batch in batches:
            hashes, counts = [], []
            for _, _, data, limits in _parts(batch.column("text"), 8_000_000):
                rows, _, _, h = _terms(data, limits)
                found, n = np.unique(_distinct(rows, h)[1], return_counts=True)
                hashes.append(found)
                counts.append(n)
            if hashes:
                h, back = np.unique(np.concatenate(hashes), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["term_hash", "n_docs"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term_hash long, n_docs long")
    return found.groupBy("term_hash").agg(F.sum("n_docs").alias("n_docs"))


def _slots(h: np.ndarray) -> np.ndarray:
    return (tb.mix64(h.view(np.uint64)) >> np.uint64(64 - _MARKS)).astype(np.int64)


def _bitmap(telling: DataFrame) -> np.ndarray:
    """One bit for each slot that a telling term has; what has no bit is no telling term."""

    def run(batches):
        for batch in batches:
            slot = _slots(batch.column("term_hash").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    got = telling.select("term_hash").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (_MARKS - 6), dtype=np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words.view(np.uint64)


def locate(docs: DataFrame, telling: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, start, end, action, bits): where telling terms (term_hash, action, bits) stand, outside of base and secret spans, in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(telling))
    rows = docs.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))

    def run(batches):
        words = shared.value
        for batch in batches:
            for low, high, data, limits in _parts(batch.column("text")):
                r, starts, ends, h = _terms(data, limits)
                slot = _slots(h)
                hit = words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1) == 1
                r, starts, ends, h = r[hit], starts[hit], ends[hit], h[hit]
                if not len(r):
                    continue
                spans: list[list] = [[] for _ in range(high - low)]
                for k in np.unique(r).tolist():
                    spans[k] = sum(protected(batch.column("text")[low + k].as_py()), [])
                free, s, e = _outside(data, limits, r, starts, ends, spans)
                at = pa.array(low + r[free])
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("version").take(at), pa.array(h[free].view(np.int64)), pa.array(s[free].astype(np.int32)), pa.array(e[free].astype(np.int32))], ["doc", "version", "term_hash", "start", "end"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, version long, term_hash long, start int, end int").join(telling, "term_hash").drop("term_hash")


def evidence_bits(share: Column, prior: Column, contexts: Column) -> Column:
    """What ``contexts`` sightings say for a share over a prior: their number times the divergence of the two, in bits."""
    rest = F.when(share < 1, (1 - share) * F.log2((1 - share) / F.greatest(1 - prior, F.lit(1e-12)))).otherwise(0.0)
    return contexts / share * (share * F.log2(share / prior) + rest)


def disclosures(held: DataFrame, frequency: DataFrame, total: int, min_contexts: int = 2, min_share: float = 0.5, min_bits: float = 4.0, chance_bits: float = 10.0) -> DataFrame:
    """(term_hash, entity, joint, n_contexts, n_docs, n_entity, share, bits) of all pairs over the thresholds.

    ``held`` as by ``held_entities``, ``frequency`` (term_hash, n_docs) of all
    terms, ``total`` documents. A pair's evidence must exceed what the best of
    all terms has by chance, log2 of their number, by ``chance_bits``.
    """
    seen = held.select(F.explode("holds").alias("x")).groupBy("x.entity").agg(F.count("*").alias("n_entity"))
    of_entity = written(seen, "entities")
    # A term in more documents than this is below the share with every entity.
    most = (of_entity.agg(F.max("n_entity")).first()[0] or 0) / max(min_share, 1e-9)
    needed = math.log2(max(2, frequency.count())) + chance_bits
    wide = frequency.where((F.col("n_docs") > most) & (F.col("n_docs") * _WIDE > total)).select("term_hash")
    pairs = held.select("holds", F.explode("terms").alias("term_hash")).join(F.broadcast(wide), "term_hash", "left_anti").select("term_hash", F.inline("holds"))
    contexts = pairs.groupBy("term_hash", "entity", "context").agg(F.count("*").alias("rows"))
    joint = contexts.groupBy("term_hash", "entity").agg(F.sum("rows").alias("joint"), F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= min_contexts)
    share, prior = F.least(F.lit(1.0), F.col("joint") / F.col("n_docs")), F.col("n_entity") / F.lit(float(max(1, total)))
    scored = joint.join(of_entity, "entity").join(frequency, "term_hash").withColumn("share", share).withColumn("bits", F.log2(F.col("share") / prior))
    return scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits) & (evidence_bits(F.col("share"), prior, F.col("n_contexts")) >= needed))


def find(docs: DataFrame, min_contexts: int = 2, min_share: float = 0.5, min_bits: float = 4.0, remove_share: float = 0.8, chance_bits: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, counts, base, secrets, added array<struct<start,end,action,bits>>) for every row of ``docs``.

    ``added`` holds all terms that disclose an entity of the corpus: action
    "remove" from a share of ``remove_share`` on, else "generalise"; null where
    there is none. ``min_contexts`` different texts (for a class: values) must
    show a pair, and its evidence must stand out from chance.
    """
    found = written(find_base(docs, id_col, text_col), "pii")
    frequency = written(document_frequencies(docs, text_col), "terms")
    disclosing = disclosures(held_entities(found), frequency, found.count(), min_contexts, min_share, min_bits, chance_bits)
    telling = written(disclosing.groupBy("term_hash").agg(F.max(F.when(F.col("share") >= remove_share, "remove").otherwise("generalise")).alias("action"), F.max("bits").alias("bits")), "telling")
    spans = locate(docs, telling, id_col, text_col).groupBy("doc", "version", "start", "end").agg(F.max("action").alias("action"), F.max("bits").alias("bits"))
    per_doc = spans.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action", "bits"))).alias("added"))
    right = per_doc.withColumnRenamed("doc", "d").withColumnRenamed("version", "v")
    return found.drop("entities", "terms").join(right, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left").drop("d", "v")


def sanitise(text: str | None, base: str, added: list | None, secrets: list | None = None) -> str:
    """The text with base and secret spans and disclosing terms taken out or generalised."""
    text, cuts = text or "", []
    for part in base.split(",") if base else []:
        kind, start, end = part.split(":")
        cuts.append((int(start), int(end), f"[{kind.upper()}]"))
    cuts += [(x["start"], x["end"], "[SECRET]") for x in secrets or []]
    cuts += [(x["start"], x["end"], "" if x["action"] == "remove" else "[TERM]") for x in added or []]
    out, at = [], 0
    for start, end, new in sorted(cuts):
        if start >= at:
            out += [text[at:start], new]
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]
