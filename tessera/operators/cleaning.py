"""Cleaning and validation of records by task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as t

REQUIRED = {
    "vqa": ("image", "question", "answer"),
    "image_captioning": ("image", "caption"),
    "classification": ("text", "label"),
    "seq2seq": ("source", "target"),
    "causal_lm": ("text",),
}


def detect_task(columns: list[str]) -> str:
    """The task that a record's fields speak for; classification if none does."""
    names = set(columns)
    has_image = bool(names & {"image", "image_path"})
    if {"question", "answer"} <= names:
        return "vqa"
    if has_image and names & {"caption", "text"}:
        return "image_captioning"
    if {"text", "label"} <= names:
        return "classification"
    if {"source", "target"} <= names:
        return "seq2seq"
    return "classification"


def required_fields(task: str, configured: dict | None = None) -> tuple[str, ...]:
    return tuple((configured or {}).get(task) or REQUIRED.get(task, ("text",)))


def clean(df: DataFrame, task: str) -> DataFrame:
    """The cleaning of a task; unknown tasks get all text columns cleaned."""
    if task == "vqa":
        return clean_vqa(df)
    if task == "image_captioning":
        return clean_captions(df)
    if task == "classification":
        return clean_classification(df)
    return df.withColumns({f.name: t.clean_text(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})


def _image_path(df: DataFrame) -> dict:
    found = [F.col(c) for c in ("image", "image_path") if c in df.columns]
    return {"image_path": t.first_filled(*found).cast("string")} if found else {}


def clean_vqa(df: DataFrame) -> DataFrame:
    """Rows with question and answer, both cleaned."""
    kept = df.dropna(subset=["question", "answer"])
    return kept.withColumns({"question": t.clean_text(F.col("question")), "answer": t.clean_text(F.col("answer")), **_image_path(df)})


def clean_captions(df: DataFrame) -> DataFrame:
    found = [F.col(c) for c in ("caption", "text") if c in df.columns]
    caption = t.first_filled(*found)
    return df.withColumns({"caption": t.clean_text(caption), **_image_path(df)}).where(F.coalesce(*found).isNotNull())


def clean_classification(df: DataFrame) -> DataFrame:
    return df.withColumns({"text": t.clean_text(F.col("text")), "label": t.strip(F.col("label").cast("string"))})


def is_valid(df: DataFrame, required: list[str]) -> bool:
    """False for no rows, or if a required column is absent. Only presence counts: nulls pass."""
    return set(required) <= set(df.columns) and not df.isEmpty()


def violations(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: how many rows there are, and how many lack each required value."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required])


def selection_violations(df: DataFrame) -> DataFrame:
    """Rows of selection input that break its structure, with the first rule they break."""
    bad_set = F.exists("filtered_datasets", lambda x: x.isNull() | x["data_ids"].isNull())
    rule = (
        F.when(F.col("report").isNull() | (F.trim("report") == ""), "report")
        .when(F.col("agent_list").isNull(), "agent_list")
        .when(F.col("filtered_datasets").isNull() | (F.size("filtered_datasets") == 0), "filtered_datasets")
        .when(bad_set, "data_ids")
    )
    return df.withColumn("rule", rule).where(F.col("rule").isNotNull())


def option_rows(df: DataFrame, letters: dict[str, str], image: str | None = None, convert_letters: bool = True) -> DataFrame:
    """Flat question and answer rows from option columns; rows that lack one of them are left out."""
    options = t.option_map({k: F.col(c) for k, c in letters.items()})
    out = df.withColumns({"q": t.build_question(F.col("question"), F.col("hint"), options), "a": t.answer_text(F.col("answer"), options) if convert_letters else t.strip(F.col("answer"))})
    keep = t.not_empty(F.col("q")).isNotNull() & t.not_empty(F.col("a")).isNotNull()
    return out.where(keep & F.col(image).isNotNull() if image else keep)


def common_fields(columns: list[str], wanted: tuple[str, ...]) -> list[str]:
    """The wanted fields that a table has, in the order in which they are wanted."""
    return [c for c in wanted if c in set(columns)]


def dataset_statistics(df: DataFrame, text_col: str, label_col: str | None = None) -> DataFrame:
    """One row: number of rows, shortest, longest and mean text, number of labels."""
    size = F.length(text_col)
    aggs = [F.count("*").alias("total"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("avg_length")]
    return df.agg(*aggs, *([F.countDistinct(label_col).alias("n_labels")] if label_col else []))


def label_histogram(df: DataFrame, label_col: str) -> DataFrame:
    return df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))


#: The names under which a table has its images, the first one counts.
IMAGE_FIELDS = ("image", "image_path", "image_base64", "image_url")


def dataset_profile(df: DataFrame, order: str) -> DataFrame:
    """One row: total, fields, sample (the first row by ``order``, as JSON), image_field, and lengths of text, question and caption where they are.

    Lengths are structs of min, max and avg over the rows that have the field,
    null if the table lacks it; 0 where no row has it.
    """
    there = set(df.columns)
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    size = lambda c: F.length(F.col(c).cast("string"))
    filled = lambda x: F.coalesce(x, F.lit(0)).cast("double")
    lengths = [(F.struct(filled(F.min(size(c))).alias("min"), filled(F.max(size(c))).alias("max"), filled(F.avg(size(c))).alias("avg")) if c in there else F.lit(None).cast("struct<min:double,max:double,avg:double>")).alias(f"{c}_length") for c in ("text", "question", "caption")]
    image = next((c for c in IMAGE_FIELDS if c in there), None)
    return df.agg(F.count("*").alias("total"), F.array(*[F.lit(c) for c in df.columns]).alias("fields"), F.min_by(row, order).alias("sample"), F.lit(image).cast("string").alias("image_field"), *lengths)
