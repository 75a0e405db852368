import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup, minhash, suffix
from tessera.llm.components import connected_components
from tessera.llm.storage import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def rows_of(texts):
    return [(k, x, "en", "s", len(x or "")) for k, x in enumerate(texts)]


# Passages.


def brute_passages(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        cover = np.zeros(len(raw) + 1, dtype=int)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                cover[k] += 1
                cover[k + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(raw)] > 0
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_passages_equal_brute_force(spark):
    r = random.Random(5)
    base = "".join(r.choice("ab ") for _ in range(700))
    texts = [base, base[100:450] + "x" * 130 + base[:300], "ab" * 400, "ab" * 90 + "ba" * 200, None, "", "é" * 230 + base[200:330], "\x00" * 250, "q" + "\x00" * 101, base, base[:99], base[:100], base[50:151] * 2]
    texts += ["".join(r.choice("abc") for _ in range(r.randrange(50, 400))) + base[r.randrange(300) :][: r.randrange(90, 260)] for _ in range(30)]
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(5)
    got = {x.doc: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.dedup(df).collect()}
    assert got == brute_passages(list(enumerate(texts)))


@pytest.mark.parametrize("limits", [{"SEGMENT": 150}, {"HOT_BYTES": 300}, {"MOST_STRINGS": 3, "_FLUSH": 5}, {"HOT_BYTES": 0, "SEGMENT": 400}])
def test_passages_do_not_depend_on_bounds(spark, monkeypatch, limits):
    r = random.Random(6)
    base = "".join(r.choice("ab ") for _ in range(500))
    texts = [base, base[:260] + "é" * 90 + base[100:], "ab" * 400, "x" * 900, "x" * 300 + base, None, base[::-1] * 2, (base[:83] + "\n") * 9]
    texts += [f"{k} {base[:180]} {k * 7}" for k in range(30)]
    for name, value in limits.items():
        monkeypatch.setattr(suffix, name, value)
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(4)
    got = {x.doc: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.dedup(df).collect()}
    assert got == brute_passages(list(enumerate(texts)))


def test_passages_of_very_long_texts(spark):
    period = " ".join(words(14, 3))[:83] + "\n"
    texts = ["a" * 20_000_000, period * 60_000, "".join(words(400_000, 5)), "b" * 99 + "a" * 5_000_000]
    got = {x.doc: x for x in suffix.dedup(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert (got[0].n_removed, got[0].n_spans) == (20_000_000 - 1, 1)
    assert got[1].n_removed == len(texts[1]) - len(period) and got[1].n_spans == 1
    assert got[2].n_removed == 0 and got[3].n_removed == 5_000_000


def test_passages_odd_rows(spark):
    base = " ".join(words(60, 1))
    df = spark.createDataFrame([(1, base, "x"), (1, base, "x"), (None, base, "y"), (2, None, None)], "doc_id long, text string, version string")
    got = sorted((x.doc is None, x.doc or 0, x.n_removed) for x in suffix.dedup(df, with_text=True).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 0, len(base))]
    assert suffix.dedup(df.limit(0)).count() == 0


def test_closed_borders_are_short_prefixes():
    r = random.Random(2)
    pieces = ["".join(r.choice("ab") for _ in range(60)).encode() for _ in range(6)]
    text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64) + 1, 0) for p in pieces])
    order = suffix.suffix_order(text, 12)
    closed = suffix.closed_borders(text[order - 1], 12)
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :][:12].tolist(), text[order[k] :][:12].tolist()
        if 0 not in a and 0 not in b and len(a) == len(b) == 12:
            assert closed[k] == (a != b)


# Lines.


def test_lines_equal_brute_force(spark):
    r = random.Random(3)
    common = [" Shared Line ", "shared line", "other\tline", "Ünïcode LINE"]
    texts = ["\n".join(r.choice([*common, " ".join(words(3, r.random())), "", "  "]) for _ in range(r.randrange(0, 90))) for _ in range(40)] + [None, "", "\n\n", "\n".join(["shared line"] * 200)]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for k, x in enumerate(texts):
        for line in {key(v) for v in (x or "").split("\n")}:
            holders.setdefault(line, set()).add(k)
    lost = {k for k, v in holders.items() if k and len(v) >= 10}
    assert lost
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept) for x in linededup.drop_lines(df, linededup.keep_bitmaps(df)).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()}
    for k, x in enumerate(texts):
        lines = (x or "").split("\n")
        kept = [v for v in lines if key(v) not in lost]
        assert got[k] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    first = linededup.drop_lines(df, linededup.keep_bitmaps(df, keep_first=True)).select("kept").collect()
    everything = [key(v) for x in first for v in x.kept.split("\n")]
    assert all(everything.count(k) == 1 for k in lost)


def test_lines_odd_rows(spark):
    df = spark.createDataFrame([(None, "a\nb", 1)] * 12 + [(5, None, 2)], "doc_id long, text string, keep long")
    out = linededup.drop_lines(df, linededup.keep_bitmaps(df))
    assert sorted(x.n_dropped for x in out.collect()) == [0] + [2] * 12
    assert out.select("row.*").columns == ["doc_id", "text", "keep"]
    empty = df.limit(0)
    assert linededup.drop_lines(empty, linededup.keep_bitmaps(empty)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_lines_of_repeated_ids_and_sql(spark, tmp_path):
    from tessera.llm import entry
    from tests.duck import same

    rows = [(1, "said twelve times\nown")] * 12 + [(None, "without an id")] * 11 + [(k, "nine times only") for k in range(20, 29)] + [(40, None), (41, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = entry.op8_line_dedup(spark, str(tmp_path))
    same(found, con.execute(entry.OP8_SQL).df())
    assert sorted(x.n_dropped for x in found.collect()) == [0] * 11 + [1] * 11 + [2] * 12


def test_lines_of_a_very_long_text(spark):
    lines = [f"line {k}" for k in range(200_000)]
    for k in (5, 70_000, 199_999):
        lines[k] = " SHARED "
    rows = [(0, "\n".join(lines)), *[(k, "shared") for k in range(1, 12)]]
    got = {x.doc_id: x for x in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), linededup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (200_000, 3)
    assert got[0].kept == "\n".join(x for x in lines if x != " SHARED ")


# Near duplicates.


def brute_classes(texts, least=0.8):
    """Single-link classes by the same weights, pair by pair."""
    n = len(texts)
    bags = []
    for x in texts:
        w = (x or "").encode().split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        bags.append({g: grams.count(g) for g in grams})
    df = {}
    for b in bags:
        for g in b:
            df[g] = df.get(g, 0) + 1
    idf = lambda g: 1 - minhash.SPAN * min(1, max(0, np.log(max(df[g] / n * minhash.COMMON, 1)) / np.log(minhash.COMMON))) if df[g] * minhash.COMMON >= n else 1.0
    weights = [{g: (1 + np.log(t)) * idf(g) for g, t in b.items()} for b in bags]
    parent = list(range(n))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(n):
        for j in range(i):
            a, b = weights[i], weights[j]
            low, high = sum(min(a.get(g, 0), b.get(g, 0)) for g in a), sum(max(a.get(g, 0), b.get(g, 0)) for g in {**a, **b})
            same = (texts[i] or "").split() == (texts[j] or "").split()
            if same or high and low / high >= least - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for v in range(n):
        groups.setdefault(root(v), []).append(v)
    return {v: min(g) for g in groups.values() for v in g}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    bases = [words(n, n) for n in (40, 90, 250, 400)]
    texts = [" ".join(b) for b in bases]
    for b in bases:
        for _ in range(8):
            c = list(b)
            for _ in range(r.randrange(0, max(2, len(b) // 12))):
                c[r.randrange(len(c))] = "".join(r.choice("xyz") for _ in range(5))
            texts.append(" ".join(c))
    texts += [" ".join(words(80, 100 + k)) for k in range(10)] + [None, "", " \n", "one", "one", "two words", " ".join(bases[0]) + "\n"]
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(4)
    got = {x.doc: x.class_doc for x in minhash.near_duplicates(df).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_odd_rows(spark):
    text = " ".join(words(30, 4))
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 1), (7, "x", 2)], "doc_id long, text string, key long")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 4 and {(x.doc, x.class_doc, x.class_size, x.stays) for x in got} == {(1, 1, 3, True), (None, 1, 3, False), (7, 7, 1, True)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sampling_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    for size in (60, 2000):
        h = r.integers(1, 2**63, size, dtype=np.uint64)
        shared = int(size * 0.8)
        hits = []
        for kind, _, slots in minhash.sketches(np.repeat([0, 1], [size, shared]), np.concatenate([h, h[:shared]]), np.ones(size + shared), 2):
            hits.append((kind, float((slots[0] == slots[1]).mean())))
        assert hits and all(abs(x - 0.8) < 0.2 for _, x in hits)


@pytest.mark.parametrize("size", [60, 110, 125, 155, 165, 190, 400, 3000])
def test_candidates_are_found_on_both_sides_of_the_full_sample(size):
    """Pairs just over the threshold share a bucket and look alike, whichever sketches their weights give them."""
    r = np.random.default_rng(size)
    n, found = 120, 0
    for _ in range(n):
        own = size - int(size * 0.81 * 2 / 1.81)  # similarity of 0.81 for two sets of this size
        h = r.integers(1, 2**63, size + own, dtype=np.uint64)
        rows = np.repeat([0, 1], size)
        sets = np.concatenate([np.sort(h[:size]), np.sort(h[own:])])
        kinds = {}
        for kind, at, slots in minhash.sketches(rows, sets, np.ones(2 * size), 2):
            if len(at) == 2:
                small = (slots & np.uint64(0xFF)).astype(np.uint8)
                keys = minhash.band_keys(kind, slots)
                kinds[kind] = (keys[0] == keys[1]).any() and (small[0] == small[1]).mean() >= 0.6
        found += any(kinds.values())
    assert found >= 0.98 * n


def similar_pairs(texts, least=0.8):
    """All pairs of different word sequences with a plain Jaccard similarity of ``least``, by an inverted index."""
    docs = {}
    for k, x in enumerate(texts):
        w = tuple((x or "").encode().split())
        docs.setdefault(w, k)
    sets = {k: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for w, k in docs.items() if w}
    index = {}
    for k, grams in sets.items():
        for g in grams:
            index.setdefault(g, []).append(k)
    shared = {}
    for own in index.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    return [(a, b) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)]


def test_near_duplicates_recall_on_a_real_table(spark, sf):
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    pairs = similar_pairs(rows.text.tolist())
    got = {x.doc: x.class_doc for x in minhash.near_duplicates(spark.createDataFrame(rows)).collect()}
    ids = rows.doc_id.tolist()
    together = sum(got[ids[a]] == got[ids[b]] for a, b in pairs)
    print("similar pairs", len(pairs), "in one class", together)
    assert len(pairs) >= 40 and together >= 0.95 * len(pairs)


def test_near_duplicates_of_very_long_texts(spark):
    long = words(300_000, 8)
    texts = [" ".join(long), " ".join(long[:150_000] + ["edit"] + long[150_001:]), " ".join(long[::-1]), "short"]
    got = {x.doc: x.class_doc for x in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), DOCS).selectExpr("*", "1 AS key", "2 AS version")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_hot_group_is_cut_into_blocks(spark, monkeypatch):
    base = words(200, 1)
    texts = []
    for k in range(60):
        c = list(base)
        c[3 * k] = f"edit{k}"
        texts.append(" ".join(c))
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    assert {x.class_doc for x in minhash.near_duplicates(df).collect()} == {0}


def family(n, seed, length=120, most=6):
    """Texts around one base, each with up to ``most`` words of its own."""
    r = random.Random(seed)
    base, out = words(length, seed), []
    for k in range(n):
        c = list(base)
        for _ in range(r.randint(1, most)):
            c[r.randrange(length)] = f"own{k}x{r.random()}"
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_group_over_blocks_equals_brute_force(spark, monkeypatch, seed):
    texts = family(40, seed)
    want = brute_classes(texts)
    assert len(set(want.values())) > 1
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    assert {x.doc: x.class_doc for x in minhash.near_duplicates(df).collect()} == want


def classes_of_one_group(spark, texts, links):
    """Classes of texts that are one candidate group with these links (positions)."""
    df = spark.createDataFrame(rows_of(texts), DOCS)
    idf, _ = minhash.common_shingles(df, 5, "text")
    rows = minhash.sketch_rows(df, idf, 5, "doc_id", "text").join(df.select("doc_id", "text"), F.col("doc") == F.col("doc_id")).cache()
    keys = {x.doc: bytes(x.key) for x in rows.select("doc", "key").collect()}
    held = rows.select(F.lit(b"one").alias("label"), "key", "text", F.transform("sketches", lambda x: F.struct(x["kind"].alias("kind"), x["slots"].alias("slots"))).alias("sketches"))
    edges = spark.createDataFrame([(keys[a], keys[b]) for a, b in links], "a binary, b binary")
    found = minhash.class_labels(held, edges, spark.sparkContext.broadcast(idf), 5, 0.8)
    label = {bytes(x.node): bytes(x.label) for x in found.collect()}
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(label.get(keys[k], keys[k]), []).append(k)
    return {k: min(g) for g in groups.values() for k in g}


def test_blocks_of_a_group_meet(spark, monkeypatch):
    texts = family(60, 2)
    want = brute_classes(texts)
    assert 1 < len(set(want.values())) < 60
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    assert classes_of_one_group(spark, texts, [(0, k) for k in range(1, 60)]) == want


def test_more_firsts_than_a_block_meet(spark, monkeypatch):
    texts = [x for k in range(12) for x in family(3, 50 + k, 120, 2)]
    want = brute_classes(texts)
    assert len(set(want.values())) >= 12
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    assert classes_of_one_group(spark, texts, []) == want


def test_bucket_links_connect_all_alike():
    r = np.random.default_rng(4)
    lost = 0
    for _ in range(60):
        slots = np.repeat(r.integers(0, 255, (1, 64), dtype=np.uint8), 30, axis=0)
        change = r.random(slots.shape) < 0.24
        slots[change] = r.integers(0, 255, int(change.sum()), dtype=np.uint8)
        alike = (slots[:, None] == slots[None]).mean(axis=2) >= 0.6
        links, _ = minhash.link_bucket(slots, 0.6, 0.8)
        group = list(range(30))
        for a, b in links:
            group = [group[a] if g == group[b] else g for g in group]
        lost += sum(group[a] != group[b] for a, b in zip(*np.nonzero(alike), strict=True))
    assert lost == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    for a in got:
        for b in got:
            assert (root(a) == root(b)) == (got[a] == got[b])


def test_common_shingles_are_exact(spark):
    texts = []
    for k in range(640):
        own = words(7, 1000 + k)
        texts.append(" ".join((["all", "of", "these", "are", "shared"] if k % 58 == 0 else []) + own))
    texts[5] += " all of these are shared all of these are shared"
    idf, n = minhash.common_shingles(spark.createDataFrame(rows_of(texts), DOCS).repartition(64), 5, "text")
    df = {}
    for x in texts:
        w = x.split()
        for g in {tuple(w[k : k + 5]) for k in range(len(w) - 4)}:
            df[g] = df.get(g, 0) + 1
    want = sorted(v for v in df.values() if v * minhash.COMMON >= 640)
    assert n == 640 and len(idf.hashes) == len(want) == 1
    assert np.allclose(idf.factors, 1 - minhash.SPAN * np.log(want[0] * minhash.COMMON / 640) / np.log(minhash.COMMON))


@pytest.mark.parametrize("copies", [40, 300])
def test_what_different_texts_share_weighs_little(spark, copies):
    """A license in many different texts makes no class and parts none; copies, however many, stay together."""
    passage, base = words(100, 1), words(100, 2)
    texts = [" ".join(passage + words(150, 100 + k)) for k in range(60)]  # different, with the license
    texts += [" ".join(words(100, 300 + k)) for k in range(30)]  # different, without it
    texts += [" ".join(passage + words(8, 500 + k)) for k in range(12)]  # little else than the license
    texts += [" ".join(words(100, 700)), " ".join(passage + words(100, 700))]  # one text without and with it
    texts += [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in [10 + k % 80 for k in range(copies)]]
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(4)
    want = {k: k for k in range(102)} | {102: 102, 103: 102} | {104 + k: 104 for k in range(copies)}
    assert {x.doc: x.class_doc for x in minhash.near_duplicates(docs).collect()} == want
    plain = {x.doc: x.class_doc for x in minhash.near_duplicates(docs, floor=1.0).collect()}
    assert {plain[k] for k in range(90, 102)} == {90} and plain[103] == 103


def test_counts_of_different_texts_are_exact(spark):
    texts = [" ".join(words(40, 50) + words(200, 100 + k)) for k in range(70)] + [" ".join(words(40, 51) + words(60, 400))] * 30
    texts += [" ".join(words(200, 600) + [f"own{k}"]) for k in range(50)]
    docs = spark.createDataFrame(rows_of(texts), DOCS).repartition(4)
    for more in (0, 400):  # exact copies, which make the second way of counting
        table = docs.unionByName(spark.createDataFrame(rows_of(["copied text of six words only"] * more), docs.schema))
        reports = minhash.shingle_reports(table, 5, "text")
        idf, _ = minhash.common_shingles(table, 5, "text", reports=reports)
        names = minhash.reported(*reports, max(reports[1] / (2 * minhash.COMMON), minhash.FEW))
        rows = minhash.sketch_rows(table, idf, 5, "doc_id", "text", names)
        reps = written(rows.groupBy("key").agg(F.min("doc").alias("doc"), F.first("version").alias("version"), F.first("sketches").alias("sketches"), F.first("held").alias("held")), "reps")
        _, groups = minhash.candidate_groups(reps)
        hashes, counts, n = minhash.text_counts(table, reps, groups, names, reports[1], 5, "doc_id", "text")
        assert (n, len(set(hashes.tolist())), set(counts.tolist())) == (72 + (more > 0), 36, {70.0})
        lowered, less = idf.lowered(hashes, counts, n)
        assert len(less) == 36 and np.allclose(lowered(less), minhash.FLOOR) and np.allclose(lowered(idf.hashes[~np.isin(idf.hashes, less)]), idf.factors[~np.isin(idf.hashes, less)])


def test_weighted_jaccard_exact():
    idf = minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), 1)
    a, b = "a b c d e f g", "a b c d e f x"
    assert minhash.weighted_jaccard(pa.array([a, "", "a b"]), pa.array([b, "", "a b"]), idf, 5).tolist() == [2 / 4, 1.0, 1.0]
    assert F is not None
