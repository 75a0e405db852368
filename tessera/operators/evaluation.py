"""Text and label metrics, and the scoring of benchmark answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as a
from tessera.functions import text as t


def _rate(x: Column) -> Column:
    """Mean of a condition; 0 for no rows."""
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def accuracy(pred: Column, label: Column) -> Column:
    return _rate(pred.eqNullSafe(label))


def exact_match(pred: Column, label: Column, normalize: bool = True) -> Column:
    same = lambda x: F.lower(t.clean_text(x)) if normalize else x
    return _rate(same(pred).eqNullSafe(same(label)))


def class_counts(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """(class, tp, fp, fn, support) of each class that occurs as a label."""
    # One row for each distinct (label, pred) pair comes out of the shuffle; the rest works on these.
    pairs = df.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("as_label"), F.lit(0).cast("long").alias("as_pred"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("as_label"), F.col("n").alias("as_pred"), F.lit(0).cast("long").alias("tp")))))
    summed = sides.groupBy("class").agg(F.sum("as_label").alias("support"), F.sum("as_pred").alias("predicted"), F.sum("tp").alias("tp"))
    return summed.where("support > 0").select("class", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support")


def f1_per_class(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    counts = class_counts(df, pred, label)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    scored = counts.withColumns({"precision": precision, "recall": recall})
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def f1(df: DataFrame, average: str = "macro", pred: str = "pred", label: str = "label") -> DataFrame:
    """One row, f1: micro (equal to accuracy), macro or weighted by support, over the classes of the labels."""
    if average == "micro":
        return df.agg(accuracy(F.col(pred), F.col(label)).alias("f1"))
    classes = f1_per_class(df, pred, label)
    if average == "weighted":
        return classes.agg(F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1"))
    return classes.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"))


def with_ngrams(df: DataFrame, pred: str = "pred", label: str = "label", n: int = 4) -> DataFrame:
    """Adds the n-grams of both texts as columns _p1.._pn and _r1.._rn.

    As columns of their own they are made once for each row; inside a lambda
    they would be made again for every element.
    """
    words = df.withColumns({"_p": t.words(F.col(pred)), "_r": t.words(F.col(label))})
    made = words.withColumns({f"_{side}{k}": a.ngrams(F.col(f"_{side}"), k) for side in "pr" for k in range(1, n + 1)})
    # Hashes beside them, and those that both have: few, and found in one pass.
    hashed = made.withColumns({f"_h{side}{k}": F.transform(f"_{side}{k}", lambda x: F.xxhash64(x)) for side in "pr" for k in range(1, n + 1)})
    return hashed.withColumns({f"_hb{k}": F.array_intersect(f"_hp{k}", f"_hr{k}") for k in range(1, n + 1)})


def bleu(n: int = 4) -> Column:
    """A row's BLEU over ``with_ngrams``: shares of predicted n-grams that occur in the label, geometric mean, brevity.

    0 if the prediction is empty or one of the shares is 0.
    """
    shares = [_known_share(k) for k in range(1, n + 1)]
    logs = [F.ln(F.greatest(s, F.lit(1e-300))) for s in shares]
    log_mean = sum(logs[1:], logs[0]) / n
    brevity = F.when(F.size("_p") >= F.size("_r"), 1.0).otherwise(F.exp(1 - F.size("_r") / F.greatest(F.size("_p"), F.lit(1))))
    return F.when((F.size("_p") == 0) | (F.least(*shares, F.lit(1.0)) == 0), 0.0).otherwise(brevity * F.exp(log_mean))


def _known_share(k: int) -> Column:
    """Share of the predicted n-grams that the label has; where none is repeated the common ones need no second pass."""
    once = F.size(F.array_distinct(f"_hp{k}")) == F.size(f"_hp{k}")
    known = F.when(once, F.size(f"_hb{k}")).otherwise(F.size(F.filter(f"_hp{k}", lambda g: F.array_contains(f"_hb{k}", g))))
    return F.coalesce(F.try_divide(known, F.size(f"_p{k}")), F.lit(0.0))


def rouge_n(n: int) -> Column:
    """F1 of the sets of n-grams over ``with_ngrams``; 0 if either side has none."""
    p, r = F.array_distinct(f"_p{n}"), F.array_distinct(f"_r{n}")
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(f"_p{n}", f"_r{n}")), F.when((F.size(p) > 0) & (F.size(r) > 0), F.size(p) + F.size(r))), F.lit(0.0))


@F.pandas_udf(T.IntegerType())
def common_subsequence(x: pd.Series, y: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two word arrays, a row of the table as the bits of one number."""

    def length(p, r) -> int:
        places: dict[str, int] = {}
        for k, w in enumerate(r):
            places[w] = places.get(w, 0) | 1 << k
        full = row = (1 << len(r)) - 1
        for w in p:
            hit = row & places.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(r) - row.bit_count()

    return pd.Series([length(p, r) for p, r in zip(x, y, strict=True)], dtype="int32")


def rouge_l() -> Column:
    """F1 of the longest common subsequence of words over ``with_ngrams``."""
    return F.coalesce(F.try_divide(2.0 * common_subsequence("_p", "_r"), F.when((F.size("_p") > 0) & (F.size("_r") > 0), F.size("_p") + F.size("_r"))), F.lit(0.0))


def _mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


#: Name to aggregate over (pred, label) rows that have gone through ``with_ngrams``; see CLASS_METRICS for the others.
METRICS = {
    "accuracy": accuracy,
    "exact_match": exact_match,
    "f1_micro": accuracy,
    "bleu": lambda p, r: _mean(F.col("_bleu")),
    "rouge": lambda p, r: _mean(F.col("_rouge_1")),
    "rouge_1": lambda p, r: _mean(F.col("_rouge_1")),
    "rouge_2": lambda p, r: _mean(F.col("_rouge_2")),
    "rouge_l": lambda p, r: _mean(F.col("_rouge_l")),
}
_ROW_SCORES = {"bleu": ("_bleu", bleu), "rouge": ("_rouge_1", lambda: rouge_n(1)), "rouge_1": ("_rouge_1", lambda: rouge_n(1)), "rouge_2": ("_rouge_2", lambda: rouge_n(2)), "rouge_l": ("_rouge_l", rouge_l)}


def row_scores(df: DataFrame, names: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """Adds the scores of each row that the named metrics average, as _bleu, _rouge_1, _rouge_2, _rouge_l."""
    wanted = dict(_ROW_SCORES[n] for n in names if n in _ROW_SCORES)
    if not wanted:
        return df
    most = 4 if "_bleu" in wanted else 2
    return with_ngrams(df, pred, label, most).withColumns({name: make() for name, make in wanted.items()})


#: Name to average of the F1 of classes: what needs a row for each class first.
CLASS_METRICS = {"f1": "macro", "f1_macro": "macro", "f1_weighted": "weighted"}


def compute(df: DataFrame, names: list[str] = ("accuracy", "exact_match", "f1"), pred: str = "pred", label: str = "label") -> DataFrame:
    """One row with the known metrics among ``names``; unknown names are left out."""
    names = list(dict.fromkeys(n for n in names if n in METRICS or n in CLASS_METRICS))
    rows, classes = [n for n in names if n in METRICS], [n for n in names if n in CLASS_METRICS]
    parts = []
    if rows or not classes:
        parts.append(row_scores(df, rows, pred, label).agg(F.lit(1).alias("_one"), *[METRICS[n](F.col(pred), F.col(label)).alias(n) for n in rows]))
    if classes:
        texts = df.select(F.col(pred).cast("string").alias("p"), F.col(label).cast("string").alias("r"))
        found = f1_per_class(texts, "p", "r")
        average = {"macro": F.avg("f1"), "weighted": F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support"))}
        parts.append(found.agg(F.lit(1).alias("_one"), *[F.coalesce(average[CLASS_METRICS[n]], F.lit(0.0)).alias(n) for n in classes]))
    # Each part is one row.
    joined = parts[0] if len(parts) == 1 else parts[0].join(F.broadcast(parts[1]), "_one")
    return joined.select(*names)


def flat_token_accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    """One row: hits at equal positions of two id arrays over the number of predicted ids."""
    pairs = F.arrays_zip(F.col(pred).alias("p"), F.col(label).alias("r"))
    hits = F.size(F.filter(pairs, lambda x: x["p"] == x["r"]))
    return df.agg(F.coalesce(F.try_divide(F.sum(hits), F.sum(F.size(pred))), F.lit(0.0)).alias("accuracy"))


def answer_score(answer: Column, truth: Column) -> Column:
    """1 for the same text, 0.5 if one contains the other, else 0; case and outer white space don't count."""
    x, y = t.normalised_answer(answer), t.normalised_answer(truth)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.5).otherwise(0.0)


def scored_answers(tasks: DataFrame) -> DataFrame:
    """Score and correctness of (answer, ground_truth) rows; an answer is correct at score 1."""
    return tasks.withColumn("score", answer_score(F.col("answer"), F.col("ground_truth"))).withColumn("is_correct", F.col("score") == 1.0)


def benchmark_summary(results: DataFrame) -> DataFrame:
    """(benchmark, total, correct, accuracy, average_score, failed): failed are not correct or below 0.5."""
    bad = ~F.col("is_correct") | (F.col("score") < 0.5)
    return results.groupBy("benchmark").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.count_if(bad).alias("failed"))


def failed_cases(results: DataFrame) -> DataFrame:
    return results.where(~F.col("is_correct") | (F.col("score") < 0.5))


def report(summary: DataFrame, poor_below: float = 0.7) -> DataFrame:
    """One row over all benchmarks: the mean of their accuracies and the poor performers."""
    return summary.agg(F.count("*").alias("benchmarks"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("overall_accuracy"), F.count_if(F.col("accuracy") < poor_below).alias("poor"))


def poor_performers(summary: DataFrame, poor_below: float = 0.7) -> DataFrame:
    return summary.where(F.col("accuracy") < poor_below)


def run_counters(results: DataFrame) -> DataFrame:
    """(benchmark, processed, skipped, errors, correct) from rows with a status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("benchmark").agg(n("ok").alias("processed"), n("skipped").alias("skipped"), n("error").alias("errors"), F.count_if((F.col("status") == "ok") & F.col("is_correct")).alias("correct"))


def to_tasks(items: DataFrame, ordinal: str, taxonomy: list[str] = (), extras: list[str] = ()) -> DataFrame:
    """Benchmark items as tasks: id, question, image and truth from the first field that is filled.

    Items without a question are left out.
    """
    there = lambda names: [F.col(n).cast("string") for n in names if n in items.columns]
    pick = lambda names: t.first_filled(*[t.strip(x) for x in there(names)]) if there(names) else F.lit(None).cast("string")
    task_id = F.coalesce(pick(["id", "question_id", "questionId"]), F.concat(F.lit("task_"), F.col(ordinal).cast("string")))
    meta = [x for n in (*taxonomy, *extras) if n in items.columns for x in (F.lit(n), F.col(n).cast("string"))]
    metadata = F.map_filter(F.create_map(*meta), lambda _, v: v.isNotNull()) if meta else F.create_map().cast("map<string,string>")
    return items.select(
        task_id.alias("task_id"), pick(["question", "query", "prompt", "text", "instruction", "input", "problem"]).alias("question"),
        pick(["image", "image_path", "img", "picture", "image_url"]).alias("image"), pick(["answer", "ground_truth", "label", "target", "output"]).alias("ground_truth"), metadata.alias("metadata"),
    ).where(F.col("question").isNotNull())


def select_benchmarks(catalog: DataFrame, names: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Catalog rows by name, or by any overlap with the wanted taxonomy fields."""
    if names is not None:
        return catalog.where(F.col("name").isin(list(names)))
    if fields:
        return catalog.where(F.arrays_overlap("native_taxonomy_fields", F.array(*[F.lit(x) for x in fields])))
    return catalog


def positional_join(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """The rows of both sides at equal ``order``; an error if one side has a row that the other lacks."""
    joined = left.join(right, order, "full")
    marks = [F.col(c) for c in (f"_there_{x}" for x in "lr")]
    both = left.withColumn("_there_l", F.lit(True)).join(right.withColumn("_there_r", F.lit(True)), order, "full")
    odd = both.where(marks[0].isNull() | marks[1].isNull()).limit(1).collect()
    if odd:
        raise ValueError(f"the sides differ in length: {odd[0][order]} is on one side only")
    return joined


def first_match(left: DataFrame, right: DataFrame, key: str, right_key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Left join with the first right row of each key, in ``order``; all left rows stay."""
    firsts = right.groupBy(F.col(right_key).alias("_key")).agg(F.min(F.struct(*order, *columns)).alias("_first"))
    joined = left.join(firsts, F.col(key) == F.col("_key"), "left")
    return joined.select(*[c for c in left.columns if c not in columns], *[F.col(f"_first.{c}").alias(c) for c in columns])
