"""Agreement of several graders on a sample: difficulty, confidence, hard cases.

Input is one row for each sample and grader (weak, normal, sota): corr, train
(scores), corr_conf, train_conf (confidences). A grader without a row counts
with score 0 and confidence 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADERS = ("weak", "normal", "sota")


@dataclass(frozen=True)
class Thresholds:
    difficulty: float = 3.0
    deviation: float = 3.0
    near_sota: float = 2.5


def align(scores: DataFrame) -> DataFrame:
    """One row for each sample with all graders side by side."""
    value = lambda g, c, d: F.coalesce(F.max(F.when(F.col("cap") == g, F.col(c))), F.lit(d)).alias(f"{g}_{c}")
    columns = [value(g, c, d) for g in GRADERS for c, d in (("corr", 0.0), ("train", 0.0), ("corr_conf", 0.5), ("train_conf", 0.5))]
    return scores.groupBy("sample_id").agg(*columns, F.count("*").alias("n_graders"))


def _of(what: str) -> list[Column]:
    return [F.col(f"{g}_{what}") for g in GRADERS]


def deviation(values: list[Column]) -> Column:
    """Population standard deviation of a few columns."""
    mean = sum(values[1:], values[0]) / len(values)
    return F.sqrt(sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / len(values))


def difficulty(values: list[Column]) -> Column:
    return 0.7 * deviation(values) + 0.3 * (F.greatest(*values) - F.least(*values))


def score(aligned: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Deviations, difficulty, confidence, hard flag, combined scores and which graders' metrics are kept."""
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    out = aligned.withColumns({"corr_std": deviation(_of("corr")), "train_std": deviation(_of("train")), "difficulty": (difficulty(_of("corr")) + difficulty(_of("train"))) / 2})
    confidence = 0.3 / (1 + F.col("corr_std")) + 0.3 / (1 + F.col("train_std")) + 0.2 * mean(_of("corr_conf")) + 0.2 * mean(_of("train_conf"))
    hard = (F.col("difficulty") >= limits.difficulty) | (F.greatest("corr_std", "train_std") >= limits.deviation)
    out = out.withColumns({"confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)), "is_hard": hard, **{f"{g}_combined": (F.col(f"{g}_corr") + F.col(f"{g}_train")) / 2 for g in GRADERS}})
    keep = lambda g: F.lit(True) if g == "sota" else F.abs(F.col(f"{g}_combined") - F.col("sota_combined")) < limits.near_sota
    return out.withColumns({f"keep_{g}": keep(g) for g in GRADERS})


def hard_cases(scored: DataFrame) -> DataFrame:
    return scored.where("is_hard")


def sample_metrics(scored: DataFrame, include_hard: bool = False) -> DataFrame:
    return scored if include_hard else scored.where("NOT is_hard")


def batch_statistics(scored: DataFrame, metric_counts: DataFrame) -> DataFrame:
    """One row of counts and rates over a batch; metrics of hard samples are not pooled."""
    pooled = metric_counts.join(scored.select("sample_id", "is_hard", *[f"keep_{g}" for g in GRADERS]), "sample_id")
    kept = F.when(~F.col("is_hard") & F.when(F.col("cap") == "weak", F.col("keep_weak")).when(F.col("cap") == "normal", F.col("keep_normal")).otherwise(True), F.col("n_metrics"))
    counts = pooled.agg(F.sum("n_metrics").alias("n_metrics"), F.coalesce(F.sum(kept), F.lit(0)).alias("n_kept"))
    totals = scored.agg(F.count("*").alias("n_samples"), F.count_if("is_hard").alias("n_hard"), F.avg("difficulty").alias("avg_difficulty"), F.avg("confidence").alias("avg_confidence"))
    # Both sides are single rows of totals.
    joined = totals.withColumn("one", F.lit(1)).join(counts.withColumn("one", F.lit(1)), "one").drop("one")
    return joined.withColumn("reduction", F.coalesce(F.try_divide(F.col("n_metrics") - F.col("n_kept"), F.col("n_metrics")), F.lit(0.0)))


def pooled_metrics(scored: DataFrame, metrics: DataFrame) -> DataFrame:
    """(sample_id, cap, k, general, specific) of the metrics that a batch pools: kept graders of samples that aren't hard."""
    kept = F.when(F.col("cap") == "weak", F.col("keep_weak")).when(F.col("cap") == "normal", F.col("keep_normal")).otherwise(True)
    flags = scored.where("NOT is_hard").select("sample_id", *[f"keep_{g}" for g in GRADERS])
    return metrics.join(flags, "sample_id").where(kept).drop(*[f"keep_{g}" for g in GRADERS])


def deduplication_statistics(pooled: DataFrame, merged: DataFrame, scored: DataFrame) -> DataFrame:
    """One row of the eight figures of a batch's deduplication; rates are 0 without metrics.

    ``pooled`` are its metrics (each with one specific description), ``merged``
    what is left of them (general, specifics).
    """
    before = pooled.agg(F.count("*").alias("original_metrics"), F.lit(1).alias("one"))
    after = merged.agg(F.count("*").alias("merged_metrics"), F.coalesce(F.sum(F.size("specifics")), F.lit(0)).alias("merged_specifics"), F.lit(1).alias("one"))
    hard = scored.agg(F.count_if("is_hard").alias("hard_cases"), F.lit(1).alias("one"))
    rows = before.join(after, "one").join(hard, "one")  # three single rows
    ratio = lambda x: F.coalesce(F.try_divide(F.col(x), F.col("original_metrics")), F.lit(0.0))
    some = F.col("original_metrics") > 0
    return rows.select(
        "original_metrics", "merged_metrics", F.when(some, 1 - ratio("merged_metrics")).otherwise(0.0).alias("deduplication_rate"), ratio("merged_metrics").alias("reduction_ratio"),
        F.col("original_metrics").alias("original_specifics"), "merged_specifics", F.when(some, 1 - ratio("merged_specifics")).otherwise(0.0).alias("specific_reduction_rate"), "hard_cases",
    )


#: The mock grader's scores and number of metrics by capability.
MOCK_GRADES = {"weak": (7.5, 7.0, 2), "normal": (8.2, 8.5, 3), "sota": (8.7, 9.0, 5)}


def mock_grades(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Every sample with every grader's mock scores: a stand-in where no model is at hand."""
    spark = samples.sparkSession
    grades = spark.createDataFrame([(c, *v) for c, v in MOCK_GRADES.items()], "cap string, corr double, train double, n_metrics int")
    return samples.select(F.col(id_col).alias("sample_id")).crossJoin(F.broadcast(grades))


def with_fallback(parsed: DataFrame) -> DataFrame:
    """Scores of 5.0 at confidence 0.5 where a reply couldn't be parsed, marked as such."""
    return parsed.withColumns({"is_fallback": F.col("corr").isNull(), "corr": F.coalesce("corr", F.lit(5.0)), "train": F.coalesce("train", F.lit(5.0)), "corr_conf": F.coalesce("corr_conf", F.lit(0.5)), "train_conf": F.coalesce("train_conf", F.lit(0.5))})


#: Fields that a grader's reply must have.
REPLY_FIELDS = ("correctness_score", "correctness_confidence", "correctness_rationale", "training_quality_score", "training_quality_confidence", "training_quality_rationale", "overall_assessment")


def evaluations(replies: DataFrame, strict: bool = True) -> DataFrame:
    """Evaluation records of parsed replies: (sample_id, model_name, model_capability, reply struct, timestamp).

    Metrics get both descriptions, empty where one is missing. A reply without
    a required field is an error, or is left out if not ``strict``.
    """
    missing = F.array_compact(F.array(*[F.when(F.col(f"reply.{f}").isNull(), f) for f in REPLY_FIELDS]))
    rows = replies.withColumn("_missing", missing)
    if strict:
        rows = rows.withColumn("_missing", F.when(F.size("_missing") > 0, F.raise_error(F.concat(F.lit("a reply lacks "), F.array_join("_missing", ", ")))).otherwise(F.col("_missing")))
    filled = lambda x, c: F.coalesce(x[c], F.lit("")).alias(c)
    metrics = F.transform(F.coalesce("reply.recommended_metrics", F.array()), lambda m: F.struct(filled(m, "general_metric_description"), filled(m, "specific_metric_description")))
    return rows.where(F.size("_missing") == 0).select("model_name", "model_capability", "sample_id", *[F.col(f"reply.{f}").alias(f) for f in REPLY_FIELDS], metrics.alias("recommended_metrics"), "timestamp", F.col("reply.information_recap").alias("information_recap"))


def as_triples(evaluated: DataFrame) -> DataFrame:
    """One row for each sample with the record of each grader, as the reader of evaluation triples takes them."""
    record = F.struct(*evaluated.columns)
    newest = lambda g: F.max_by(F.when(F.col("model_capability") == g, record), F.when(F.col("model_capability") == g, F.coalesce("timestamp", F.lit(""))))
    return evaluated.groupBy("sample_id").agg(*[newest(g).alias(g) for g in GRADERS])


def with_overrides(defaults: dict[str, dict], given: dict[str, object]) -> dict[str, dict]:
    """Grader settings with those of a file laid over them; an unknown grader or an entry that is no mapping changes nothing."""
    return {g: own | (given[g] if isinstance(given.get(g), dict) else {}) for g, own in defaults.items()}
