"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet in the shared folder and reads it again for the
next, and then deletes what the stage wrote on its way. All but the last return
the columns of ``documents``, whatever further columns their input has. Nulls
may stand in any column, texts may be of any length, rows may repeat, tables may
be empty (then so is the result); each stage says what it makes of these.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cotraining, linededup, minhash, mixing
from tessera.llm.storage import read_table, scratch, small_batches, write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The columns of documents and ``times`` for each (doc, version) in ``chosen`` (doc, version, n_rows, times).

    Of ``n_rows`` rows that repeat id and text the least by its other columns stands for all.
    """
    rows = docs.select(*COLUMNS, linededup.text_hash(F.col("text")).alias("v"))
    found = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")))
    once = found.where("n_rows = 1").select(*COLUMNS, "times")
    again = found.where("n_rows > 1").groupBy("doc", "version").agg(F.min(F.struct(*COLUMNS)).alias("row"), F.first("times").alias("times"))
    return once.unionByName(again.select("row.*", "times"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the co-trained classifier accepts.

    Null and empty texts are scored as empty ones, a null language or source as
    a value of its own, very long texts over their whole; repeated rows get
    equal scores and stay or go together; so do rows of equal features. Without
    labels of both classes every row gets the share of good labels.
    """
    small_batches(spark)
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(docs.select(*COLUMNS), model).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line in ten rows or more only the first occurrence stays.

    First is by id, null last, then the text's hash and position; rows that
    repeat id and text share it. Null and empty texts have no line to lose and
    stay as they are; a text that loses lines gets its own length.
    """
    docs = docs.select(*COLUMNS)
    bitmaps = linededup.keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True)
    cut = linededup.drop_lines(docs, bitmaps)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select("row.doc_id", text.alias("text"), "row.lang", "row.source", chars.alias("n_chars"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: the least id, null last, then the least text hash.

    Texts with the same words are one class, so one of all null, empty and
    blank texts stays, and one of repeated rows.
    """
    small_batches(spark)
    classes = minhash.near_duplicates(docs)
    stays = classes.where("stays").groupBy("doc", "version").agg(F.count("*").alias("n_rows"), F.lit(1).alias("times"))
    return _of_rows(docs, stays).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows that repeat id and text give as many copies as the mix takes of them
    in all. Null and empty texts have no words; they stay as often as the whole
    copies of their source. A null source is a source of its own.
    """
    plan = mixing.mix(docs).groupBy("doc", "version").agg(F.count("*").alias("n_rows"), F.sum("times").alias("times")).where("times > 0")
    repeated = _of_rows(docs, plan)
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, checked by decoding them; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("source",))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("source mixing", source_mixing),
    ("byte bpe", byte_bpe),
]

#: Training, sampling and tokenising can't be said in SQL; tests hold each stage's decisions against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that all stages leave, each as often as the mix takes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            result = stage(spark, docs, sf_dir)
            path = write_table(result, name.replace(" ", "-"))
            keep(path)
        docs = read_table(result, path)
    return docs
