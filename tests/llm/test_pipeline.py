import base64

import corpus_pipeline
import public_tokenizers
import tiktoken

from tessera.llm.storage import written
from tests.duck import rows_of, same
from tests.llm.test_dedup import brute_classes
from tests.llm.test_models import brute_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(texts, least=10):
    """Texts by id without the later occurrences of lines in ``least`` documents or more."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders, first, out = {}, {}, {}
    for i in sorted(texts):
        for pos, line in enumerate((texts[i] or "").split("\n")):
            holders.setdefault(key(line), set()).add(i)
            first.setdefault(key(line), (i, pos))
    lost = {k for k, v in holders.items() if k and len(v) >= least}
    for i, text in texts.items():
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if key(x) not in lost or first[key(x)] == (i, pos)]
        out[i] = text if len(kept) == len(lines) else "\n".join(kept)
    return out


def test_pipeline_stages_equal_brute_force(spark, sf):
    from tessera.llm import cotraining

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf), "t")
        seen[name] = (before, after)
        if name != "byte bpe":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        before = after
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    start, graded, cut, alone = texts(docs), *[texts(seen[k][1]) for k in ("quality classifier", "line dedup", "minhash near-dedup")]
    model = cotraining.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.score for r in cotraining.score(docs, model).select("row.doc_id", "score").collect()}
    assert graded == {i: x for i, x in start.items() if scores[i] >= 0.3}
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    assert docs.join(good, "doc_id", "left_semi").join(seen["quality classifier"][1], "doc_id", "left_anti").count() <= 0.02 * good.count()
    assert cut == brute_lines(graded)
    order = sorted(cut)
    classes = brute_classes([cut[i] for i in order])
    assert set(alone) == {order[k] for k in set(classes.values())} and all(alone[i] == cut[i] for i in alone)
    rows = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in seen["minhash near-dedup"][1].collect()}
    sizes, got, times = {}, {}, {}
    for source, n in rows.values():
        sizes[source] = sizes.get(source, 0) + n
    for r in seen["source mixing"][1].collect():
        assert r.text == alone[r.doc_id]
        got[r.source] = got.get(r.source, 0) + rows[r.doc_id][1]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for source, target in brute_targets(sizes).items():
        shortest = min([n for s, n in rows.values() if s == source and n] or [1])
        assert abs(got.get(source, 0) - target) <= max(shortest, 0.01 * target) + 1
    assert max(times.values()) <= 3
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    last = before.collect()
    assert len(last) == sum(times.values())
    for r in last:
        assert r.round_trip and list(r.ids) == library.encode_ordinary(alone[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_pipeline_odd_rows(spark, tmp_path):
    long = " ".join(f"w{k % 5000}" for k in range(200_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5), (None, "q", None, "b", 1), (4, long, "en", "b", None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs.selectExpr("*", "1 AS version", "2 AS times")), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        current = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            current = written(stage(spark, current, f"{tmp_path}/{name}"), "t")
        assert (current.count() > 0) == (name == "some")
    once = corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()
    assert sorted((r.text or "").strip()[:9] for r in once) == ["", "q", long[:9], "x y z"]


def test_mixing_stage_counts_repeated_rows(spark):
    rows = [(1, "w " * 10, "en", "a", 20)] * 7 + [(k, "w " * 10, "en", "b", 20) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {s: brute_targets({"a": 70, "b": 100})[s] for s in ("a", "b")}
    got = {}
    for r in corpus_pipeline.source_mixing(spark, docs, "").collect():
        got[r.source] = got.get(r.source, 0) + 10
    assert all(abs(got[s] - want[s]) <= 5 for s in want)


def test_run_leaves_only_stage_results(spark, sf, tmp_path):
    import os

    from tessera.workdir import shared_dir

    folder = f"{shared_dir(spark).removeprefix('file://')}/tessera"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {name.replace(" ", "-") for name, _ in corpus_pipeline.STAGES}


def test_llm_queries_match_sql(spark, sf):
    from tessera.llm import entry

    for name, sql in entry.oracle_sql().items():
        same(entry.queries()[name](spark, sf), rows_of(sql, sf))


def test_all_ten_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert public_tokenizers.PATTERN
