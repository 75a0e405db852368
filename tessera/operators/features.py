"""Features of dialogues and vectors: statistics, pooling, interaction, standardisation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as a
from tessera.functions import text as t

#: Groups of the full feature vector and their widths.
GROUPS = {"image": 512, "question": 512, "answer": 512, "statistical": 11, "interaction": 9}


def feature_names(groups: dict[str, int] = GROUPS) -> list[str]:
    return [f"{g}_{k}" for g, n in groups.items() for k in range(n)]


def dialogue_statistics(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """For each dialogue: turns, and mean and deviation of words and mean characters of both sides."""
    sizes = turns.select(key, *[f(F.col(c)).alias(f"{c[0]}_{n}") for c in ("question", "answer") for n, f in (("words", lambda x: F.size(t.words(x))), ("chars", F.length))])
    aggs = [F.count("*").alias("turns")]
    for side in "qa":
        aggs += [F.avg(f"{side}_words").alias(f"{side}_words_mean"), F.stddev_pop(f"{side}_words").alias(f"{side}_words_std"), F.avg(f"{side}_chars").alias(f"{side}_chars_mean")]
    return sizes.groupBy(key).agg(*aggs)


def task_flags(task_type: Column) -> list[Column]:
    return [F.coalesce(F.contains(F.lower(task_type), F.lit(w)), F.lit(False)).cast("int").alias(f"is_{w}") for w in ("vqa", "caption", "turn")]


def mentions_image(question: Column) -> Column:
    return F.contains(question, F.lit("<image>")) | F.contains(question, F.lit("[Image_"))


def interaction(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """For each dialogue: image mention, words of both sides scaled, their ratio, mean and deviation of how adjacent questions overlap."""
    own = Window.partitionBy(key).orderBy("idx")
    nxt = F.lead("question").over(own)
    overlap = a.jaccard(F.array_distinct(t.words(F.lower("question"))), F.array_distinct(t.words(F.lower(nxt))))
    rows = turns.withColumns({"near": F.when(nxt.isNotNull(), overlap), "qw": F.size(t.words(F.col("question"))), "aw": F.size(t.words(F.col("answer")))})
    return rows.groupBy(key).agg(
        F.max(mentions_image(F.col("question")).cast("int")).alias("image_ref"), F.coalesce(F.avg("near"), F.lit(0.0)).alias("coherence"), F.coalesce(F.stddev_pop("near"), F.lit(0.0)).alias("coherence_std"),
        (F.avg("qw") / 50).alias("q_scaled"), (F.avg("aw") / 100).alias("a_scaled"), F.coalesce(F.try_divide(F.sum("aw"), F.sum("qw")), F.lit(0.0)).alias("ratio"),
    )


def vector_interaction(turns: DataFrame, vectors: DataFrame, key: str = "conv_id") -> DataFrame:
    """The nine interaction features of each dialogue with images: three cosines, then those of ``interaction``.

    ``vectors`` has (key, image, question, answer): pooled vectors of a
    dialogue. A dialogue without an image vector has zeros.
    """
    pairs = (("image", "question"), ("image", "answer"), ("question", "answer"))
    cosines = vectors.select(key, F.col("image").isNotNull().alias("_has"), *[F.coalesce(a.cosine(F.col(x), F.col(y)), F.lit(0.0)).alias(f"{x}_{y}") for x, y in pairs])
    rest = interaction(turns, key)
    columns = [*[f"{x}_{y}" for x, y in pairs], *[c for c in rest.columns if c != key]]
    joined = rest.join(cosines, key, "left")
    return joined.select(key, *[F.when(F.col("_has"), F.col(c).cast("double")).otherwise(0.0).alias(c) for c in columns])


def statistical_features(turns: DataFrame, samples: DataFrame, key: str = "conv_id") -> DataFrame:
    """The eleven statistics of each sample: those of its dialogue (zeros without turns), image count, task flags.

    ``samples`` has (key, images array, task_type).
    """
    spoken = dialogue_statistics(turns, key)
    own = samples.select(key, F.coalesce(F.size("images"), F.lit(0)).alias("n_images"), *task_flags(F.col("task_type")))
    own = own.withColumn("n_images", F.greatest("n_images", F.lit(0)))
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in spoken.columns if c != key}
    return own.join(spoken, key, "left").withColumns(zeros).select(key, *zeros, "n_images", "is_vqa", "is_caption", "is_turn")


def _vector(column: str):
    return array_to_vector(F.col(column).cast("array<double>"))


def mean_pool(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, n, pooled): mean vector of each key; vectors of a key have one length, null ones don't count."""
    rows = vectors.where(F.col(vector).isNotNull()).select(key, _vector(vector).alias("v"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("v"))).alias("pooled"))


def standardise(vectors: DataFrame, key: str, vector: str = "embedding", batch: int | None = None) -> DataFrame:
    """(key, z): every component less its mean, over its deviation (1 if that is 0).

    With ``batch`` the statistics are those of runs of so many keys, and a run
    of a single row stays as it is. Vectors of a run have one length.
    """
    group = F.floor(F.col(key) / batch) if batch else F.lit(0).cast("long")
    rows = vectors.where(F.col(vector).isNotNull()).select(key, group.alias("g"), F.col(vector).cast("array<double>").alias("v"))
    moments = rows.groupBy("g").agg(F.count("*").alias("n"), Summarizer.metrics("mean", "variance").summary(_vector("v")).alias("s"))
    # The summary's variance is over n - 1.
    spread = F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * (F.col("n") - 1) / F.col("n")))
    stats = moments.select("g", "n", vector_to_array("s.mean").alias("m"), spread.alias("d"))
    joined = rows.join(F.broadcast(stats) if batch is None else stats, "g")
    centred = F.zip_with("v", "m", lambda x, m: x - m)
    z = F.zip_with(centred, "d", lambda x, d: x / F.when(d == 0, 1.0).otherwise(d))
    return joined.select(key, F.when(F.lit(batch is not None) & (F.col("n") == 1), F.col("v")).otherwise(z).alias("z"))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``batch``: runs of ``size`` keys."""
    return df.withColumn("batch", F.floor(F.col(key) / size))


def select_groups(features: DataFrame, key: str, wanted: list[str], columns: dict[str, str]) -> DataFrame:
    """(key, features): the vectors of the wanted groups in their fixed order, one after the other; a missing one is zeros.

    ``columns`` names each group's array column; an unknown group is an error.
    """
    unknown = [g for g in wanted if g not in GROUPS]
    if unknown:
        raise ValueError(f"unknown feature groups: {', '.join(unknown)}")
    zeros = lambda g: F.array_repeat(F.lit(0.0), GROUPS[g])
    parts = [F.coalesce(F.col(columns[g]).cast("array<double>"), zeros(g)) if g in columns else zeros(g) for g in GROUPS if g in wanted]
    return features.select(key, F.concat(*parts).alias("features"))
