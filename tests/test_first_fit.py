"""The distributed first-fit pass, and early stopping, against plain folds."""

import math
import random

import pytest

from tessera.operators import history, metric_dedup
from tessera.workdir import ranked

STOPS = frozenset({"the", "of", "and"})
WORDS = "share count mean length words answers images errors the of rate ratio number tokens labels été größe".split()


def descriptions(n, seed):
    r = random.Random(seed)
    out = [("", "only specific"), ("only general", ""), ("the of", "x"), ("of the", ""), ("the and of", "y"), (" ", "z"), ("a b", "c"), ("b a", "c d")]
    for _ in range(n):
        general = [r.choice(WORDS) for _ in range(r.randrange(1, 6))]
        out.append((" ".join(general), " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 4)))))
        if r.random() < 0.5:
            out.append((" ".join([*general, r.choice(WORDS)]), " ".join(r.choice(WORDS) for _ in range(3))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("seed", "general_least", "least"), [(1, 0.65, 0.75), (2, 0.75, 0.65), (3, 0.9, 0.42), (4, 0.7, 0.3)])
def test_first_fit_in_rounds_equals_the_fold(spark, seed, general_least, least):
    items = descriptions(60, seed)
    similar = lambda x, y: metric_dedup.text_similarity(x, y, STOPS)
    want = metric_dedup.first_fit(items, similar, general_least, least)
    rows = [(k // 7, k, g, s) for k, (g, s) in enumerate(items)]
    df = spark.createDataFrame(rows, "o1 long, o2 long, general string, specific string").repartition(6)
    got = metric_dedup.fold_all(df, ["o1", "o2"], general_least, least, STOPS).collect()
    assert [(r.general, r.specifics) for r in sorted(got, key=lambda r: r.position)] == [(g, s) for g, s in want]


def test_candidates_are_few_and_lose_no_similar_pair(spark):
    items = descriptions(80, 9)
    df = spark.createDataFrame([(k, g, s) for k, (g, s) in enumerate(items)], "n long, general string, specific string")
    bound = metric_dedup.least_general(0.65, 0.75)
    pairs = {(r.a, r.b) for r in metric_dedup.candidates(df, bound, STOPS).collect()}
    near = {(a, b) for b in range(len(items)) for a in range(b) if metric_dedup.text_similarity(items[a][0], items[b][0], STOPS) >= bound}
    assert near <= pairs
    assert len(pairs) < 0.5 * len(items) * (len(items) - 1) / 2


def test_chains_settle_in_order(spark):
    """1 takes in 2, so 3 stands and takes in 4: each depends on the one before."""
    n = 40
    items = spark.range(n).selectExpr("id AS n")
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    assert {r.n: r.owner for r in metric_dedup.owners(items, edges).collect()} == {k: k - k % 2 for k in range(n)}
    late = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 5)], "a long, b long")  # 5 belongs to the first that stands
    assert {r.n: r.owner for r in metric_dedup.owners(spark.range(6).selectExpr("id AS n"), late).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 0}


def test_fold_of_nothing_and_ranks(spark):
    empty = spark.createDataFrame([], "o1 long, general string, specific string")
    assert metric_dedup.fold_all(empty, ["o1"], 0.7, 0.7, STOPS).collect() == []
    r = random.Random(1)
    values = [r.randrange(10**6) for _ in range(500)]
    got = sorted((x["rank"], x["v"]) for x in ranked(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "v").collect())
    assert [k for k, _ in got] == list(range(500)) and [v for _, v in got] == sorted(values)


def folded(losses, patience, delta):
    best, wait, stop, out = None, 0, False, []
    for value in losses:
        value = math.nan if value is None else value
        if best is None or value < best - delta:
            best, wait = value, 0
        else:
            wait += 1
        stop = stop or wait >= patience
        out.append((best, wait, stop))
    return out


@pytest.mark.parametrize("delta", [0.0, 0.3, 1.5])
@pytest.mark.parametrize("patience", [1, 3])
def test_early_stopping_equals_the_fold(spark, patience, delta):
    r = random.Random(4)
    runs = {f"r{k}": [r.choice([None, math.nan, *[v / 4 for v in range(12)]]) if k % 2 else r.randrange(40) / 8 for _ in range(r.randrange(1, 30))] for k in range(14)}
    runs[None] = [3.0, 2.0, 2.5]
    rows = [(run, e, v) for run, losses in runs.items() for e, v in enumerate(losses)]
    df = spark.createDataFrame(rows, "run string, epoch long, val_loss double").repartition(5)
    got = {}
    for x in history.early_stopping(df, patience=patience, min_delta=delta).collect():
        got.setdefault(x.run, {})[x.epoch] = (x.best, x.waited, x.stopped)
    for run, losses in runs.items():
        want = folded(losses, patience, delta)
        for e, (best, wait, stop) in enumerate(want):
            b, w, s = got[run][e]
            assert (w, s) == (wait, stop) and (b == best or math.isnan(b) and math.isnan(best))


def test_early_stopping_has_no_python_worker(spark, capsys):
    df = spark.createDataFrame([("a", 1, 0.5)], "run string, epoch long, val_loss double")
    for delta in (0.0, 0.1):
        history.early_stopping(df, min_delta=delta).explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonRDD", "")
