"""Passages by suffix automata, whitening and Exponion clustering against brute force."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import doubledouble as dd
from tessera.llm import eigen, exponion, substrings, whitening
from tessera.llm.automaton import NOWHERE, SuffixAutomaton

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, id string, x double"


# Suffix automata.


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_the_least_document_of_every_window(seed):
    r = random.Random(seed)
    texts = [[r.choice("abc" if seed % 2 else "ab") for _ in range(r.randrange(0, 40))] for _ in range(12)]
    places = [r.randrange(6) for _ in texts]
    a = SuffixAutomaton()
    for text, place in zip(texts, places, strict=True):
        a.add([ord(c) for c in text], place)
    a.close()
    for window in (1, 3, 5):
        firsts = {}
        for text, place in zip(texts, places, strict=True):
            for k in range(len(text) - window + 1):
                w = tuple(text[k : k + window])
                firsts[w] = min(firsts.get(w, NOWHERE), place)
        for text in [*texts, [r.choice("abcd") for _ in range(200)]]:
            want = [firsts.get(tuple(text[k - window + 1 : k + 1]), NOWHERE) if k >= window - 1 else NOWHERE for k in range(len(text))]
            assert a.matching([ord(c) for c in text], window) == want


def test_automaton_of_nothing():
    a = SuffixAutomaton()
    a.add([], 3)
    a.close()
    assert a.matching([1, None, 2], 1) == [NOWHERE] * 3


def brute_words(rows, window):
    split = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
    place = lambda doc: NOWHERE if doc is None else doc
    first = {}
    for doc, text in rows:
        w = split(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, NOWHERE), place(doc))
    out = []
    for doc, text in rows:
        w = split(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < place(doc):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if doc is None else doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), sum(1 for k in gone if k - 1 not in gone)))
    return sorted(out)


def odd_texts(seed, n=40):
    r = random.Random(seed)
    passage = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(passage)), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "\n".join(passage[10:40])), (None, " ".join(passage[5:30])), (None, " ".join(passage[5:30])), (7, "a " * 900), (8, "a " * 40), (8, "a " * 60)]
    rows += [(9, "ü ß  " + " ".join(passage[:20])), (10, "\x00 " * 30), (11, "\x00 " * 20), (12, " ".join(passage))]
    for k in range(n):
        cut = r.randrange(40)
        rows.append((20 + k, " ".join([r.choice("xyz") for _ in range(r.randrange(30))] + passage[cut : cut + r.randrange(4, 20)] + [f"n{r.randrange(50)}" for _ in range(r.randrange(30))])))
    return rows


def found_words(df, window, **bounds):
    got = substrings.dedup(df, window=window, **bounds).collect()
    return sorted((-1 if x.doc is None else x.doc, x.n_words, x.n_removed, x.kept_sha256, len(x.spans)) for x in got)


@pytest.mark.parametrize(("window", "bounds"), [(13, {}), (13, {"shard_words": 30}), (13, {"hot_words": 0}), (3, {"hot_words": 50, "shard_words": 40}), (5, {}), (1, {})])
def test_passages_of_earlier_documents_equal_brute_force(spark, window, bounds):
    rows = odd_texts(window)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found_words(df, window, **bounds) == brute_words(rows, window)


def test_long_texts_come_in_segments(spark, monkeypatch):
    r = random.Random(3)
    long = " ".join(str(r.randrange(10_000)) for _ in range(3000))
    rows = [(1, long), (2, "x " + long[500:9000] + " y"), (3, "z" * 700 + " " + long), (4, "q" * 5000), (5, long[::-1] * 2)]
    want = brute_words(rows, 13)
    monkeypatch.setattr(substrings, "SEGMENT", 200)
    pieces = list(substrings.segments(__import__("pyarrow").array([x for _, x in rows]), 13))
    assert len(pieces) > 50
    assert found_words(spark.createDataFrame(rows, DOCS), 13) == want


def test_passages_of_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, doc string, ref long, gone int, h long"
    assert substrings.dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(k, "a b c d e f g h i j k l m n", "q", 1, 2, 3) for k in range(3)]
    got = {x.doc: (x.n_removed, x.kept) for x in substrings.dedup(spark.createDataFrame(rows, schema), with_text=True).collect()}
    assert got == {0: (0, "a b c d e f g h i j k l m n"), 1: (14, ""), 2: (14, "")}


@pytest.mark.parametrize("bounds", [{}, {"round_words": 40, "shard_words": 20}])
def test_passages_of_a_reference_table(spark, bounds):
    passage = [f"w{k}" for k in range(50)]
    known = spark.createDataFrame([(" ".join(passage[:20]),), (" ".join(passage[25:]),), (None,), ("short",)], "text string")
    rows = [(1, "a b " + " ".join(passage) + " c"), (2, " ".join(passage[8:33])), (3, None), (4, " ".join(passage[3:12]))]
    got = {x.doc: (x.n_removed, x.kept) for x in substrings.against(spark.createDataFrame(rows, DOCS), known, window=8, with_text=True, **bounds).collect()}
    assert got == {1: (45, "a b w20 w21 w22 w23 w24 c"), 2: (20, "w20 w21 w22 w23 w24"), 3: (0, ""), 4: (9, "")}


# Eigenpairs and double-double.


def matrices():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(40, 40)))
    yield from (np.zeros((0, 0)), np.array([[3.0]]), np.eye(9), np.zeros((5, 5)), np.ones((12, 12)), 1e200 * np.diag([1.0, 2, 3]))
    yield q @ np.diag(10.0 ** -np.arange(40)) @ q.T  # graded
    yield q @ np.diag(np.r_[np.ones(20), 1 + 1e-14 * np.arange(20)]) @ q.T  # all but equal
    yield np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    for n in (2, 3, 17, 64, 130):
        x = r.normal(size=(n + 3, n))
        yield x.T @ x


@pytest.mark.parametrize("k", range(14))
def test_eigenpairs(k):
    a = list(matrices())[k]
    a = (a + a.T) / 2
    w, v = eigen.symmetric(a)
    size = max(1e-300, float(np.abs(a).max(initial=0)))
    assert np.all(np.diff(w) <= 0)
    assert np.abs(a @ v - v * w).max(initial=0) <= 1e-13 * size * max(1, len(a)) ** 0.5
    assert np.abs(v.T @ v - np.eye(len(a))).max(initial=0) <= 1e-13
    assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max(initial=0) <= 1e-13 * size * max(1, len(a))


def test_eigenpairs_of_what_is_no_matrix():
    with pytest.raises(ValueError, match="non-finite"):
        eigen.symmetric(np.array([[np.nan]]))


def test_double_double_keeps_what_doubles_lose():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=500) * 10.0 ** r.integers(-15, 15, 500) for _ in range(2)])
    x = np.concatenate([x, -x[:900]])
    high, low = dd.total(x[:, None], np.zeros((len(x), 1)))
    exact = sum(map(Fraction, x.tolist()))
    assert abs(Fraction(float(high[0])) + Fraction(float(low[0])) - exact) <= abs(sum(map(abs, map(Fraction, x.tolist())))) * Fraction(1, 2**95)
    p, e = dd.two_product(x, x[::-1], dd.halves(x), dd.halves(x[::-1]))
    assert all(Fraction(a) * Fraction(b) == Fraction(c) + Fraction(d) for a, b, c, d in zip(x.tolist(), x[::-1].tolist(), p.tolist(), e.tolist(), strict=True))


# Whitening.


def drawn(n, d, seed=0, base=0.0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.linspace(1, 3, d)
    return (r.normal(size=(n, d)) @ mix * 0.1 + base).astype(np.float32)


def exact_covariance(x):
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    centred = [[Fraction(row[k]) - Fraction(s[k], n) for k in range(d)] for row in x]
    return s, [[sum(a[i] * a[j] for a in centred) / n for j in range(d)] for i in range(d)]


def test_whitening_equals_exact_arithmetic(spark):
    vectors = drawn(160, 6)
    rows = [(k, [float(v) for v in x], "a", 0.5) for k, x in enumerate(vectors)]
    bad = [(900, None, "a", 0.0), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], "a", 0.0), (902, [float("nan")] * 6, "a", 0.0), (903, [float("inf")] * 6, "a", 0.0)]
    rows += [rows[3], (None, rows[4][1], "b", 1.0), (5, rows[6][1], "c", 1.0)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(7)).collect()
    x = [[math.floor(1024 * v) + 100_000 for v in row[1]] for row in rows]
    s, v = exact_covariance(x)
    n = len(x)
    w, q = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    w, q = w[::-1], q[:, ::-1]
    assert len(got) == 6 * n
    assert {r.n for r in got} == {n}
    want = sorted((-1 if row[0] is None else row[0], sum((n * a - b) ** 2 for a, b in zip(y, s, strict=True))) for row, y in zip(rows, x, strict=True))
    assert sorted((-1 if r.id is None else r.id, r.deviation) for r in got if r.component == 1) == want
    trace = float(sum(v[k][k] for k in range(6)))
    for r in got:
        c = r.component - 1
        assert r.explained == pytest.approx(w[c] / trace, rel=1e-12)
        assert r.identity_error < 1e-12
    for c in range(6):
        mine = sorted(abs(r.whitened) for r in got if r.component == c + 1)
        theirs = sorted(abs(float(np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(y, s, strict=True)]) @ q[:, c]) / math.sqrt(w[c])) for y in x)
        assert mine == pytest.approx(theirs, abs=1e-9)


def test_covariance_is_right_to_the_last_bits(spark):
    """Offsets far above the spread: plain sums of squares would lose it all."""
    r = np.random.default_rng(4)
    x = (10**15 + r.integers(-9, 9, size=(300, 70))).astype(np.int64)
    df = spark.createDataFrame([(k, [int(v) for v in row]) for k, row in enumerate(x)], "id long, x array<bigint>").repartition(6)
    s = [int(c) for c in x.sum(axis=0)]
    middle = [dd.nearest(Fraction(c, 300)) for c in s]
    got = whitening.covariance(df, "x", 70, 300, (np.array([m[0] for m in middle]), np.array([m[1] for m in middle])))
    for i, j in ((0, 0), (3, 69), (65, 66), (69, 69)):
        exact = sum((Fraction(int(a)) - Fraction(s[i], 300)) * (Fraction(int(b)) - Fraction(s[j], 300)) for a, b in zip(x[:, i], x[:, j], strict=True)) / 300
        assert got[i, j] == pytest.approx(float(exact), rel=4e-16)


def test_whitening_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a", 0.0)], VECTORS)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    flat = [(k, [0.5, float(k), 0.25], "a", 0.0) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert {(r.component, round(r.explained, 9)) for r in got} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    assert {r.whitened for r in got if r.component > 1} == {0.0}
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0], "a", 0.0), (2, [0.0, 3.0], "a", 0.0), (3, [], "a", 0.0)], VECTORS)).collect()
    padded = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0], "a", 0.0), (2, [0.0, 3.0], "a", 0.0), (3, [0.0, 0.0], "a", 0.0)], VECTORS)).collect()
    plain = lambda rows: sorted((r.id, r.component, r.deviation, round(r.whitened, 12)) for r in rows)
    assert plain(ragged) == plain(padded)
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0], "a", 0.0), (2, [-3e38, 1.0], "a", 0.0)], VECTORS)).collect()
    assert {r.deviation for r in huge} == {2**63 - 1}


# Exponion.


def brute_clusters(rows, k, rounds, d):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x, *_ in rows if x is not None and len(x) == d and all(v is not None and math.isfinite(v) for v in x)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~"
    c = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for turn in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for _, x in kept]  # noqa: B023
        if turn < rounds:
            new = []
            for j in range(len(c)):
                mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
                new.append([sum(v) // len(mine) for v in zip(*mine, strict=True)] if mine else c[j])
            c = new
    dist = [far(x, c[a]) for (_, x), a in zip(kept, at, strict=True)]
    inertia = {j: sum(v for v, a in zip(dist, at, strict=True) if a == j) for j in set(at)}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted((-1 if i is None else i, a, v, inertia[a], sum(dist), sha[a]) for (i, _), a, v in zip(kept, at, dist, strict=True))


def clusters(df, k, rounds, d):
    got = exponion.cluster(df, k=k, rounds=rounds, d=d).collect()
    return sorted((-1 if r.id is None else r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), got


@pytest.mark.parametrize(("n", "k", "d", "grid"), [(300, 12, 5, 0), (300, 25, 2, 4), (200, 40, 3, 2), (7, 40, 3, 0), (1, 3, 2, 0), (150, 1, 4, 0), (90, 2, 1, 3)])
def test_clusters_equal_brute_force(spark, n, k, d, grid):
    """Grids have many ties and equal vectors."""
    r = np.random.default_rng(n + k)
    x = (r.integers(-grid, grid + 1, size=(n, d)) / 256 if grid else r.normal(size=(n, d))).astype(np.float32)
    rows = [(i, [float(v) for v in y], "a", 0.0) for i, y in enumerate(x)]
    rows += [(n, None, "a", 0.0), (n + 1, [0.0] * (d + 1), "a", 0.0), (n + 2, [None] * d, "a", 0.0), (n + 3, [float("nan")] * d, "a", 0.0), (None, [0.25] * d, "a", 0.0), rows[0]]
    got, _ = clusters(spark.createDataFrame(rows, VECTORS).repartition(5), k, 4, d)
    assert got == brute_clusters(rows, k, 4, d)


def test_bounds_save_scans_and_lose_nothing(spark):
    r = np.random.default_rng(8)
    centre = r.normal(size=(40, 64)) * 2
    x = (centre[r.integers(40, size=1500)] + r.normal(size=(1500, 64)) * 0.05).astype(np.float32)
    rows = [(i, [float(v) for v in y], "a", 0.0) for i, y in enumerate(x)]
    got, full = clusters(spark.createDataFrame(rows, VECTORS), 40, 5, 64)
    assert got == brute_clusters(rows, 40, 5, 64)
    assert sum(r.scanned for r in full) < 0.5 * 1500 * 40 * 6


def test_clusters_of_empty_tables_and_huge_numbers(spark):
    assert exponion.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert exponion.cluster(spark.createDataFrame([(1, None, "a", 0.0)], VECTORS)).collect() == []
    rows = [(k, [float(np.float32(v)) for v in y], "a", 0.0) for k, y in enumerate(np.random.default_rng(3).normal(size=(30, 2)) * 1e9)]
    got, _ = clusters(spark.createDataFrame(rows, VECTORS), 4, 3, 2)
    limit = 2**63 - 1
    assert got == sorted((i, a, min(limit, v), min(limit, s), min(limit, t), sha) for i, a, v, s, t, sha in brute_clusters(rows, 4, 3, 2))
    beyond = spark.createDataFrame([(1, [3e38, 0.0], "a", 0.0), (2, [-3e38, 0.0], "a", 0.0)], VECTORS)
    assert {r.cluster for r in exponion.cluster(beyond, k=2, d=2).where(F.col("distance") == 0).collect()} == {0, 1}
