"""Line deduplication with DataFrame functions only.

Lines become (hash, document, position) rows. These are range-partitioned by
hash and salt with a secondary sort by document and position; one pass over
each run counts its documents and finds its first occurrence. The salt splits
the run of a hot line over several ranges, whose few summaries are then added
up. The result is a compressed keep bitmap per document, never text.

Defined results: a row is a document, also if it repeats another row's id or
text or has no id; null and empty text is one empty line; lines whose key is
shorter than ``min_chars`` are never dropped; rows with the same id and text
share one bitmap (for a kept first occurrence that means each of them keeps
it); an empty table gives an empty result; columns beside id and text,
whatever their names, are carried along untouched by ``drop_lines``; texts of
any length are split whole, in time and memory linear in their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
SALTS = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, version, pos): a 128-bit key hash of each line that is long enough."""
    lines = docs.select(F.col(id_col).alias("doc"), text_hash(F.col(text_col)).alias("version"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc", "version", "pos")


def frequent_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, first): keys in ``min_docs`` documents or more, with their first occurrence."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "version"), F.lit(SALTS)).cast("int"))
    ranged = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.col("doc").asc_nulls_last(), "version", "pos")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version", "pos")
    at_doc = ranged.groupBy("h1", "h2", "salt", "doc", "version", "pos").agg(F.count("*").alias("copies"))
    runs = at_doc.groupBy("h1", "h2", "salt", "doc", "version").agg(F.max("copies").alias("copies"), F.min(place).alias("first"))
    per_salt = runs.groupBy("h1", "h2", "salt").agg(F.sum("copies").alias("n_docs"), F.min("first").alias("first"))
    return per_salt.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs)


def bitmap_words(words: Column) -> Column:
    """array<bigint> indexed by word from array<struct<word,bits>> sorted by word; words in between keep all their lines."""

    def filled(x: Column, i: Column) -> Column:
        gap = x["word"] - F.coalesce(F.get(words, i - 1)["word"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(-1).cast("long"), gap), F.array(x["bits"]))

    return F.flatten(F.transform(words, filled))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, n_dropped, keep array<bigint>) for documents that lose a line.

    Bit ``pos % 64`` of word ``pos div 64`` is 1 for a kept line. The array
    ends with the last word that drops a line; what lies beyond it, like a
    document missing from the result, keeps all its lines. This is the
    compression. ``version`` is the text's hash.
    """
    rows = written(line_rows(docs, id_col, text_col, min_chars), "lines")
    # A written table joins from a plain exchange, so that Spark splits a hot key's rows or, if it is small, broadcasts it.
    frequent = written(frequent_lines(rows, min_docs), "frequent").withColumnRenamed("h1", "k1").withColumnRenamed("h2", "k2")
    lost = rows.join(frequent, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    if keep_first:
        lost = lost.where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("version") == F.col("first.version")) & (F.col("pos") == F.col("first.pos"))))
    words = lost.groupBy("doc", "version", F.expr("shiftright(pos, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    listed = words.groupBy("doc", "version").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("words"))
    return listed.select("doc", "version", "n_dropped", bitmap_words(F.col("words")).alias("keep"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row struct of all columns, n_lines, n_dropped, kept): each document with its kept text."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), text_hash(F.col(text_col)).alias("_version"))
    joined = packed.join(bitmaps, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_version") == F.col("version")), "left")
    lines = split_lines(F.col("_text"))
    bit = lambda i: F.coalesce(F.get("keep", F.shiftright(i, 6)), F.lit(-1).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63))))
    kept = F.when(F.col("keep").isNull(), F.coalesce(F.col("_text"), F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: bit(i) != 0), "\n"))
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))
