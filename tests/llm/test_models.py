import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe, cotraining, mixing, pii, quality_rules, topk, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Byte pairs.


def test_bpe_equals_library(spark, coder, library, sf):
    r = random.Random(3)
    odd = [None, "", "a" * 3000, "ab" * 2500, " " * 900, "\x1c \x1d\x85  x 　", "é" * 700 + "!" * 600, "it's we'll  \n\n x", "<|endoftext|>"]
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x10000, 0x1FFFF), r.randrange(0, 32)])) for _ in range(60)) for _ in range(400)]
    for x in odd:
        ids = coder.encode(x)
        assert ids == library.encode_ordinary(x or "") and coder.decode_ids(ids) == (x or "").encode()
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for d in bpe.round_trip_digests(rows, RANKS, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(odd[d.doc_id] or "")
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((odd[d.doc_id] or "").encode()).hexdigest())


def test_bpe_every_code_point(coder, library):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for k in range(0, len(points), 4000):
        text = "".join(f"{c}'s1{c}'s a{c} " for c in points[k : k + 4000 : 3])
        assert coder.encode(text) == library.encode_ordinary(text)


def test_bpe_encode_decode_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (1, "hello world", "s"), (None, None, None)], "doc_id long, text string, ids string")
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(len(r.ids) for r in out.collect()) == [0, 2, 2] and all(r.round_trip for r in out.collect())
    assert sorted(bytes(r.data) for r in bpe.decode(out, RANKS, public_tokenizers.PATTERN).collect()) == [b"", b"hello world", b"hello world"]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Mixing.


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[v] for v in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: float(most * sizes[s]) for s in over}


def test_mix_meets_targets(spark):
    r = random.Random(1)
    rows = []
    for k in range(400):
        source = r.choice(["a", "b", "é", "z", None, "tiny"]) if k else "tiny"
        n = r.choice([0, 1, 3, 7, 20, 60, 61]) if source != "tiny" else 2
        rows.append((k, " ".join("w" for _ in range(n)) or None, source))
    sizes = {}
    for _, x, s in rows:
        sizes[s] = sizes.get(s, 0) + len((x or "").split())
    want = brute_targets(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source").withColumnRenamed("doc_id", "doc"), "doc").collect()
    assert len(got) == 400
    for s, target in want.items():
        own = [x for x in got if x.source == s]
        assert all(abs(x.target - target) < 1e-6 and x.source_size == sizes[s] and 0 <= x.times <= 3 for x in own)
        assert abs(sum(x.size * x.times for x in own) - target) <= 2
    again = {(x.doc, x.times) for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {(x.doc, x.times) for x in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_fit_counts_is_best(spark):
    r = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.unique(r.integers(1, 30, 5))
        counts = r.integers(1, 4, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(r.integers(0, total + 5))
        taken = mixing.fit_counts(lengths, counts, budget, 1, 10_000)
        assert ((taken >= 0) & (taken <= counts)).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert int((taken * lengths).sum()) == min(sums, key=lambda s: (abs(s - max(budget, 0)), s))


def test_fit_counts_with_one_long_document():
    lengths, counts = np.array([1, 2, 3, 10_000_000]), np.array([50_000, 50_000, 50_000, 1])
    taken = mixing.fit_counts(lengths, counts, 9_785_000, 1, 20_000)
    assert taken.tolist() == [0, 0, 0, 1]
    few = mixing.fit_counts(np.array([100, 1000]), np.array([1, 1]), 500, 1, 20_000, 3)
    assert few.tolist() == [3, 0]
    dense = mixing.fit_counts(np.arange(1, 3000), np.full(2999, 3), 6_000_123, 1, 20_000)
    assert int((dense * np.arange(1, 3000)).sum()) == 6_000_123


def test_mix_with_many_sources_and_odd_rows(spark):
    rows = [(k, "w " * (k % 7 + 1), f"host{k % 300}", k) for k in range(900)] + [(None, "w w", None, 1), (None, "w w", None, 1), (5, None, "empty", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(6)
    sizes = {}
    for _, x, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((x or "").split())
    want = brute_targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(round(x.target, 6), 0)
    assert set(by) == {round(v, 6) for v in want.values()}
    assert abs(sum(x.size * x.times for x in got) - sum(sizes.values())) <= 301 * 2


# Quality rules.


def brute_base(text):
    raw = (text or "").encode()
    words = raw.split()
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(3)}
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_base_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    rows = [(int(i), x) for i, x in zip(docs.doc_id, docs.text, strict=True)][:120] + [(10_000, None), (10_001, ""), (10_002, "a b c a b c a b c\na b c"), (10_003, "\n é é \x0b x\n é é \x0b x")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(x)
        assert not (r.kept and r.base_failed)


def test_quality_verdicts():
    limits = quality_rules.Limits()
    assert quality_rules.line_fault(b"Home | News | Sports | About | Contact", limits) == "navigation"
    assert quality_rules.line_fault(b"Licensed under the Apache License, Version 2.0.", limits) == "boilerplate"
    assert quality_rules.line_fault(b"WORDS!! AND!! MORE!! WORDS!! HERE!!", limits) == "punctuation"
    assert quality_rules.line_fault(b"A plain sentence with a mark at its end.", limits) is None
    assert quality_rules.cleaned("Good line, it ends well.\nHome | A | B | C\nGood line, it ends well.") == "Good line, it ends well."


def brute_kept(text):
    """The verdict, line by line on characters instead of bytes."""
    seen, whole, lost, junk = set(), 0, 0, 0
    ends = tuple(".!?\"':;)…”»。")
    for line in (text or "").split("\n"):
        bare = line.strip(" \t\n\r\x0b\x0c")
        if not bare:
            continue
        size = len(bare.encode())
        whole += size
        words = line.encode().split()
        n = len(words)
        marks = len(re.findall(r"[|»•·]|>>", line))
        ended = bare.endswith(ends)
        menu = n <= 6 and not ended and re.match(r"(?ai)^\W*(" + "|".join(quality_rules.MENU).replace("\\w", "[a-zA-Z0-9_]") + r")(?![a-zA-Z0-9_\x80-\U0010ffff])", line)
        upper, lower = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
        if marks >= 2 and marks >= 0.2 * n or menu:
            fault = "navigation"
        elif len(re.findall(r"[#*$%&|<>]", line)) > 0.2 * n + 1 or line.count("!") > 0.3 * n + 1 and upper > lower or n < 8 and not ended:
            fault = "punctuation"
        elif n <= 60 and re.search("(?i)" + "|".join(quality_rules.BOILERPLATE), line) or line in seen:
            fault = "boilerplate"
        else:
            fault = None
        seen.add(line)
        lost += size * (fault is not None)
        junk += size * (fault not in (None, "boilerplate"))
    return not brute_base(text)[-1] and (lost / whole if whole else 0.0) <= 0.4 and junk <= 0.2 * whole


def test_quality_verdict_equals_brute_force(spark, sf):
    r = random.Random(5)
    lines = ["Accueil | Suivant", "Startseite", "Alle Rechte vorbehalten und nichts sonst hier in dieser langen Zeile.", "BUY!! NOW!! ALL!! OF!! IT!!", "# * $ % &", "bare words only", "Zurück", "Zurückhaltung ist gut, sagt man hier.", "Política de cookies de este sitio web que se lee aquí."]
    sound = ["This line has quite enough of plain words and ends well.", "Une phrase entière qui finit bien par un point ici.", "Noch ein ganzer Satz, der ordentlich mit einem Punkt endet."]
    texts = ["\n".join(f"{r.choice(sound)} {k}." if r.random() < 0.8 else r.choice(lines) for k in range(r.randrange(1, 30))) for _ in range(150)]
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").toPandas().text.tolist()
    texts += [x for x in docs if x and len(x) < 3000][:400] + [None, "", "\n", texts[0]]
    rows = spark.createDataFrame([(k, x, k, True) for k, x in enumerate(texts)], "doc_id long, text string, n_words long, kept boolean")
    got = {x.doc_id: x.kept for x in quality_rules.judge(rows).collect()}
    assert got == {k: brute_kept(x) for k, x in enumerate(texts)}
    assert 0 < sum(got.values()) < len(got) and quality_rules.judge(rows.limit(0)).count() == 0


def test_very_long_texts_are_read_whole(spark):
    """A text of two megabytes, whose last words matter, through each operator that works row by row."""
    text = " ".join(f"w{k % 977} is written here." for k in range(90_000))
    df = spark.createDataFrame([(4, text + " wretch", "s", 1), (5, text, "s", 2), (5, text, "s", 3)], "doc_id long, text string, source string, size long")
    n = len(text.split())
    assert sorted(x.n_words for x in quality_rules.judge(df).collect()) == [n, n, n + 1]
    assert sorted(x.size for x in mixing.mix(df).collect()) == [n, n, n + 1]
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    scored = cotraining.score(df, cotraining.fit(df, labels))
    assert scored.count() == 3 and scored.select("row.*").columns == df.columns
    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), -1.0)
    for _, bucket, _ in toxicity.gram_buckets(np.frombuffer(b"wretch", np.uint8), np.array([0, 6])):
        model.table[bucket] = 90.0
    a, b = (toxicity.text_logits(pa.array([x]), model)[0] for x in (text + " wretch", text))
    assert a > b
    assert {x.n_tokens > n for x in bpe.round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()} == {True}


def test_quality_agrees_with_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.99 and rows[rows.quality == 0].kept.mean() < 0.1


# Classifiers.


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean())


def test_cotraining_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = cotraining.fit(docs, labels.where("doc_id % 4 <> 1"), each_class=400)
    held = labels.where("doc_id % 4 = 1")
    got = cotraining.score(docs.join(held, "doc_id", "left_semi"), model).select("row.doc_id", "score", "kept", "text_score", "meta_score").join(held, "doc_id").toPandas()
    y = got.quality.to_numpy()
    both, text, meta = auc(y, got.score.to_numpy()), auc(y, got.text_score.to_numpy()), auc(y, got.meta_score.to_numpy())
    print("held-out AUC: both", both, "text", text, "meta", meta)
    assert both > 0.97 and text > 0.95 and both >= max(text, meta) - 0.01
    assert got[got.quality == 1].kept.mean() > 0.99


def plain_logistic(x, y, weight, l2, steps=120, rate=0.1):
    """The same Adam on the same loss, one number at a time."""
    d = len(x[0])
    w, b, m, v, mb, vb = [0.0] * d, 0.0, [0.0] * d, [0.0] * d, 0.0, 0.0
    total = sum(weight)
    for t in range(1, steps + 1):
        error = [(1 / (1 + np.exp(-(sum(a * c for a, c in zip(row, w, strict=True)) + b))) - label) * u / total for row, label, u in zip(x, y, weight, strict=True)]
        g = [sum(e * row[k] for e, row in zip(error, x, strict=True)) + l2 * w[k] for k in range(d)]
        gb = sum(error)
        for k in range(d):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        b -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def test_cotraining_fits_like_a_plain_model():
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 4)).astype(np.float32)
    y = (x[:, 0] + 0.3 * r.normal(size=30) > 0).astype(int)
    weight = r.uniform(0.5, 2, 30)
    view = cotraining.fit_logistic(x, y, weight, 1e-2)
    w, b = plain_logistic(x.tolist(), y.tolist(), weight.tolist(), 1e-2)
    assert np.allclose(view.weights, w, atol=1e-3) and abs(view.bias - b) < 1e-3


def test_cotraining_hands_over_the_surest_of_all_documents(spark, monkeypatch):
    """A round's rows equal a plain ranking of all unlabelled documents by the other view."""
    r = random.Random(4)
    good, bad = ["river", "stone", "garden", "window"], ["buy", "cheap", "click", "win"]
    rows = []
    for k in range(240):
        pool = good if k % 2 else bad
        rows.append((k, " ".join(r.choice(pool + ["and", "the"]) for _ in range(r.randrange(5, 40))) if k % 17 else None, r.choice(["en", None]), "a" if r.random() < (0.9 if k % 2 else 0.2) else "b", None))
    rows += [rows[100], (None, "river stone", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen = []

    def spy(xt, xm, y, prior, more, rounds, seed):
        def watched(views, step):
            got = more(views, step)
            seen.append(({n: cotraining.View(v.weights.copy(), v.bias) for n, v in views.items()}, got))
            return got

        return plain(xt, xm, y, prior, watched, rounds, seed)

    plain = cotraining.co_train
    monkeypatch.setattr(cotraining, "co_train", spy)
    cotraining.fit(docs, labels, rounds=2, each_round=5, sure=0.6)
    free = {(i, t, la, s) for i, t, la, s, _ in rows if i is not None and i >= 60}
    batch = pa.RecordBatch.from_pylist([{"id": i, "text": t, "lang": la, "source": s, "n_chars": None} for i, t, la, s in sorted(free, key=lambda x: x[0])], pa.schema([("id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    (_, _, xt, xm), *_ = list(cotraining.both_features(batch))
    views, first = seen[0]
    half = lambda x: x.astype(np.float16).astype(np.float32)
    for name, x, other, given in (("text", xt, "meta", xm), ("meta", xm, "text", xt)):
        z = views[name].raw(x)
        limit = np.log(0.6 / 0.4)
        for value, ranked in ((0, z), (1, -z)):
            order = np.lexsort((np.arange(len(z)), ranked))
            best = [k for k in order if ranked[k] <= -limit][:5]
            rows_given = first[other][0][first[other][1] == value]
            assert sorted(map(tuple, half(given)[best].tolist())) == sorted(map(tuple, rows_given.tolist()))
    assert len(seen) == 2


def test_cotraining_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = cotraining.fit(df, none)
    assert cotraining.score(df, model).count() == 3
    assert cotraining.score(df.limit(0), model).count() == 0
    one = cotraining.fit(df, spark.createDataFrame([(1, 1, 0)], none.schema))
    assert cotraining.score(df.select("doc_id", "text"), one).where("kept").count() == 3


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, each_class=600)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.toxic.to_numpy(), got.score.to_numpy()) > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)
    shut = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END"))
    assert np.array_equal(toxicity.fit(docs, shut, each_class=100).table, toxicity.fit(docs, labels, each_class=100).table)


def test_toxicity_trains_like_a_plain_model():
    """Joint training equals the same steps with plain loops over words and vectors."""
    texts = ["bad bad word", "good day", "bad egg", "good good egg", "fine word", "bad day"]
    labels = np.array([1, 0, 1, 0, 0, 1])
    dim, steps, rate, scale = 2, 3, 0.5, 200.0
    model = toxicity.train(toxicity.bags(pa.array(texts)), labels, 0.3, dim, steps, 8, rate, scale, 0.0, 5)
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.02, (1 << toxicity.BUCKET_BITS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2)
    bags = []
    for text in texts:
        bag = {}
        for word in set(text.split()):
            raw = f" {word} ".encode()
            for n in toxicity.SIZES:
                for k in range(len(raw) - n + 1):
                    if raw[k] == raw[k + n - 1] == 32:  # not both word limits
                        continue
                    h = 2166136261 + n
                    for b in raw[k : k + n]:
                        h = ((h ^ b) * 16777619) % 2**32
                    h ^= h >> 15
                    h = h * 0x2C1B3C6D % 2**32
                    bag[h >> 16] = bag.get(h >> 16, 0) + 1
        bags.append({b: c / (sum(bag.values()) + toxicity.SMOOTH) for b, c in bag.items()})
    grown_v, grown_s, grown_b = {}, np.full((dim, 2), 1e-3), np.full(2, 1e-3)
    for _ in range(steps):
        rng.permutation(len(texts))
        step_v, step_s, step_b = {}, np.zeros((dim, 2)), np.zeros(2)
        for bag, label in zip(bags, labels, strict=True):
            hidden = sum(c * vectors[b] for b, c in bag.items()) * scale
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= 0.5 / (labels == label).sum()
            step_s += np.outer(hidden, p)
            step_b += p
            for b, c in bag.items():
                step_v[b] = step_v.get(b, 0) + c * scale * (soft @ p)
        for b, g in step_v.items():
            grown_v[b] = grown_v.get(b, np.full(dim, 1e-3)) + g**2
            vectors[b] = vectors[b] - rate * g / np.sqrt(grown_v[b])
        for x, grown, g in ((soft, grown_s, step_s), (bias, grown_b, step_b)):
            grown += g**2
            x -= rate * g / np.sqrt(grown)
    used = sorted(grown_v)
    assert np.allclose(model.table[used], vectors[used] @ (soft[:, 1] - soft[:, 0]) * scale, rtol=1e-2, atol=1e-2)
    assert abs(model.bias - np.log(0.3 / 0.7)) < 1e-9 and not model.table[[k for k in range(500) if k not in grown_v]].any()


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark):
    chance, y, size = np.array([5, 1, 3, 2, 9, 7]), np.array([1, 1, 1, 0, 0, 0]), np.array([4, 4, 4, 1, 1, 1])
    assert toxicity.within(chance, y, size, 18).tolist() == [False, True, True, True, True, True]
    rows = [(k % 9, f"wretch{k % 3} fine words" if k % 2 else "calm plain words") for k in range(400)] + [(8, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, most_entries=300)
    assert np.array_equal(model.table, toxicity.fit(docs.repartition(7), labels, most_entries=300).table) and model.table.any()


def test_toxicity_sees_misspellings():
    r = random.Random(1)
    plain = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(6)) for _ in range(300)]
    texts, y = [], []
    for k in range(400):
        w = [r.choice(plain) for _ in range(40)]
        if k % 2:
            for _ in range(2):
                w[r.randrange(40)] = "wretchbucket"
        texts.append(" ".join(w))
        y.append(k % 2)
    model = toxicity.train(toxicity.bags(pa.array(texts)), np.array(y), 0.5)
    clean = " ".join(plain[:40])
    z = toxicity.text_logits(pa.array([clean, clean + " wretchbuckett", clean + " wretchbuckit", "", None, "1"]), model)
    assert z[1] > z[0] and z[2] > z[0] and z[3] == z[4] == model.bias


def test_toxicity_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "x", 6)], "doc_id long, text string, score long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, toxicity.fit(df, none)).collect()
    assert len(got) == 3 and not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.score(df.limit(0), toxicity.fit(df, none)).count() == 0


# Personal data.


def brute_pii(text):
    text = text or ""
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(n if k % 2 == 0 else (2 * n if 2 * n < 10 else 2 * n - 9) for k, n in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def test_pii_base_equals_brute_force(spark, sf):
    r = random.Random(2)
    bits = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (456) 555-2186", "+12", "é", " ", "12", ".", "-", "\n", "1.2.3.4.5", "00001.2.3.4", "+", "m-n%o@p-q.co.uk."]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    for x in texts:
        assert pii.base_spans(x) == brute_pii(x)
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().text
    assert all(pii.base_spans(x) == brute_pii(x) for x in docs)


def test_pii_long_runs_are_linear():
    for x in ("a" * 300_000 + "@", "1" * 300_000 + ".1", "+1" + " " * 300_000, "x@" + "a." * 100_000 + " @", "1." * 100_000):
        assert len(pii.base_spans(x)) in (0, 1, 25_000)


def test_pii_disclosing_terms(spark):
    rows = [(k, f"call zanzibarius{k % 2} about item {k} at bob@x.org thanks{k} and more words {k * 7}") for k in range(8)]
    rows += [(100 + k, f"call about item {k} and more words thanks") for k in range(40)] + [(200, None), (201, ""), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = pii.find(df, min_bits=1.0, chance_bits=0.0).collect()
    assert len(got) == len(rows)
    by = {r.doc: r for r in got}
    text = rows[0][1]
    terms = [text[x["start"] : x["end"]] for x in by[0].added]
    assert "zanzibarius0" in terms and "call" not in terms and "words" not in terms
    assert by[200].base == "" and by[100].added is None
    clean = pii.sanitise(text, by[0].base, by[0].added)
    assert "bob@x.org" not in clean and "[EMAIL]" in clean and "zanzibarius" not in clean
    assert pii.find(df.limit(0)).count() == 0


def test_pii_terms_far_away_and_in_other_documents(spark):
    far = " ".join(f"plain{k}" for k in range(30))
    rows = [(k, f"Zanzibarius é wrote {far} variant{k} to bob@x.org zanzibarius@x.org") for k in range(6)]
    rows += [(50, f"here {far} is zanzibarius again")] + [(100 + k, f"{far} to wrote here is again {k}") for k in range(60)]
    got = {r.doc: (r.added or []) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), min_bits=1.0, chance_bits=0.0).collect()}
    cut = lambda k: [dict(rows)[k][x["start"] : x["end"]].lower() for x in got[k]]
    assert all(cut(k).count("zanzibarius") == 1 for k in (0, 1, 2, 3, 4, 5, 50))
    assert not got[100] and "plain3" not in cut(0)


def test_pii_evidence_is_texts_and_rare_entities_count(spark):
    footer = "for all questions please contact our office jane roequist jane@x.org any day of the week from nine on"
    rows = [(k, f"{' '.join(f'body{k}n{j}' for j in range(12))} {footer}") for k in range(5)]
    rows += [(20 + k, f"a letter of Quillfeather about {k} items to lonely@x.org with thanks") for k in range(2)]
    rows += [(30, "a letter of Onceseen about items to single@x.org with thanks")]
    rows += [(100 + k, f"for all questions please contact our office any day of the week from nine on a letter of about items to with thanks {k}") for k in range(60)]
    got = {r.doc: (r.added or []) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), min_bits=1.0, chance_bits=0.0).collect()}
    cut = lambda k: [dict(rows)[k][x["start"] : x["end"]] for x in got[k]]
    assert all({"jane", "roequist"} <= set(cut(k)) and "office" not in cut(k) for k in range(5))
    assert cut(20) == cut(21) == ["Quillfeather"]
    assert not got[30] and not got[100]  # one text is no evidence: any of its words would do


def brute_disclosing(rows, min_contexts, min_share, min_bits, chance_bits):
    """Terms that disclose, by plain counting: over whole texts, for values and for kinds."""
    docs, df = [], {}
    for _, text in rows:
        text = text or ""
        spans = sum(pii.protected(text), [])
        clear = {m.group() for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", text.lower()) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
        for t in set(re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())):
            df[t] = df.get(t, 0) + 1
        values = {pii.entity_of(k, text[a:b]) for k, a, b in spans}
        least = {}
        for v in values:
            least.setdefault(v.split(":")[0], set()).add(v)
        docs.append((text, clear, values, least))
    out = set()
    entities = {v for *_, values, _ in docs for v in values} | {("any", k) for *_, least in docs for k in least}
    for e in entities:
        holds = [d for d in docs if (e[1] in d[3] if isinstance(e, tuple) else e in d[2])]
        prior = len(holds) / len(rows)
        for t in set().union(*[d[1] for d in holds]):
            own = [d for d in holds if t in d[1]]
            groups = len({frozenset(d[3][e[1]]) if isinstance(e, tuple) else d[0] for d in own})
            share = min(1.0, len(own) / df[t])
            bits = np.log2(share / prior)
            kl = share * bits + ((1 - share) * np.log2((1 - share) / (1 - prior)) if share < 1 else 0)
            if groups >= min_contexts and share >= min_share and bits >= min_bits and groups / share * kl >= np.log2(len(df)) + chance_bits:
                out.add(t)
    return out


def test_pii_disclosure_equals_brute_force(spark):
    r = random.Random(8)
    names = ["ada", "brüno", "cleo", "dana"]
    rows = []
    for k in range(160):
        w = [f"w{r.randrange(60)}" for _ in range(25)]
        if k % 8 == 0:
            who = r.choice(names)
            w[r.randrange(12)] = who.upper() if k % 3 else who
            w[r.randrange(13, 25)] = f"{who}@mail.org"
        if k % 10 == 3:
            w[5], w[6] = "passkey", "".join(r.choice("0123456789abcdef") for _ in range(40))
        if k % 13 == 5:
            w[9], w[10] = "host", f"10.{k}.0.7"
        rows.append((k, " ".join(w)))
    rows += [(r.randrange(160), rows[8][1]), (1000, None), (1001, ""), (1002, "ada alone")]
    limits = dict(min_contexts=2, min_share=0.5, min_bits=2.0, chance_bits=1.0)
    want = brute_disclosing(rows, **limits)
    assert {"passkey", "host"} <= want and want & set(names)
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(text or "")
    found = {}
    for x in got:
        own = [t for t in texts[x.doc] if len(t) >= max([s["end"] for s in x.added or []], default=0)]
        for s in x.added or []:
            for t in own:
                found.setdefault(x.doc, set()).add((s["start"], s["end"]))
    for doc, options in texts.items():
        if len(options) == 1:
            spans = sum(pii.protected(options[0]), [])
            hits = {(m.start(), m.end()) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", options[0].lower()) if m.group() in want and not any(a < m.end() and m.start() < b for _, a, b in spans)}
            assert found.get(doc, set()) == hits


def test_pii_leaves_clean_documents_alone(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = pii.find(docs).toPandas()
    held = (got.n_email + got.n_ip + got.n_card + got.n_phone + got.secrets.map(len)) > 0
    assert held.any() and got.added.map(lambda x: x is not None and len(x) > 0)[~held].sum() <= 0.001 * len(got)


def test_pii_odd_rows(spark):
    secret = "a1b2c3d4e5f6a7b8c9d0e1f2"
    df = spark.createDataFrame([(None, f"key {secret} at a@b.cd", "p", 1), (None, None, None, 2), (7, f"key {secret} at a@b.cd", "q", 3), (8, "x" * 300_000 + f" {secret}9", None, 4)], "doc_id long, text string, base string, start long")
    got = pii.find(df).collect()
    assert sorted(len(x.secrets) for x in got) == [0, 1, 1, 1] and {len(x.base) for x in got} == {0, len("email:32:38")}
    assert pii.sanitise(f"key {secret} at a@b.cd", "email:32:38", [], [{"start": 4, "end": 28}]) == "key [SECRET] at [EMAIL]"
    assert pii.secret_spans("a" * 400_000 + "1", []) == [] and pii.find(df.limit(0)).count() == 0


# Search.


def brute_topk(rows, k=5):
    use = [(i, [int(np.floor(np.float64(v) * 256)) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = {}
    for i, x in use:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j) for j, y in use if j != i)
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("part", [4096, 60])
def test_topk_equals_brute_force(spark, part):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(k, [float(np.float32(v)) for v in r.normal(size=6)]) for k in range(400)] + [(401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5), (405, [1.0, 2.0]), (None, [1.0] * 6)]
    rows += [(500 + k, rows[3][1]) for k in range(12)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for x in topk.search(df, F.col("id") % 50 == 0, part_rows=part).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_topk(rows)
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def brute_part(x, ids, q, q_ids, k=5):
    full = (q @ x.T).astype(np.int64)
    full[q_ids[:, None] == ids[None, :]] = topk._EMPTY
    order = np.lexsort((np.broadcast_to(ids, full.shape), ~full), axis=1)[:, :k]
    return np.take_along_axis(full, order, 1), ids[order]


def test_topk_prunes_blocks_and_stays_exact():
    r = np.random.default_rng(2)
    x = np.floor(256 * np.repeat(r.normal(size=(16, 12)) * 3, 64, axis=0) + r.normal(size=(1024, 12)) * 8)
    part, ids = topk.Part(np.arange(1024), x, 64), np.arange(1024)
    q = x[::100]
    scores, found = part.search(ids[::100], q, np.full(len(q), topk._EMPTY), 5)
    want = brute_part(x, ids, q, ids[::100])
    assert (scores == want[0]).all() and (found == want[1]).all()
    assert part.opened < 0.7 * q.shape[0] * 1024


def test_topk_prunes_rows_of_the_real_table(spark, sf):
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.floor(256 * np.stack(rows.embedding.to_numpy()).astype(np.float64))
    ids = rows.vec_id.to_numpy()
    part = topk.Part(ids, x)
    asked = ids % 50 == 0
    scores, found = part.search(ids[asked], x[asked], np.full(asked.sum(), topk._EMPTY), 5)
    want = brute_part(x, ids, x[asked], ids[asked])
    assert (scores == want[0]).all() and (found == want[1]).all()
    assert part.scored < 0.6 * asked.sum() * len(ids)


@pytest.mark.parametrize("spans", [1024, 3])
def test_topk_sends_chunks_only_where_a_floor_can_be_met(spark, monkeypatch, spans):
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(10, 8)) * 4, 60, axis=0) + r.normal(size=(600, 8)) * 0.05
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1050, [9.0] * 11)]
    monkeypatch.setattr(topk, "SPANS", spans)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for v in topk.search(df, F.col("id") % 50 == 0, part_rows=50).collect():
        got.setdefault(v.query_id, []).append((v["rank"], v.vec_id, v.score))
    wide = [(i, list(v) + [0.0] * (11 - len(v))) for i, v in rows]
    assert {q: sorted(v) for q, v in got.items()} == brute_topk(wide)


def test_topk_huge_values_are_exact():
    q, x = np.array([[2.0**60, 3.0]]), np.array([[1.0, 1.0], [2.0, -1.0], [2.0**60, 0.0]])
    assert topk.exact_scores(q, x).tolist() == [[2**60 + 3, 2**61 - 3, 2**63 - 1]]
