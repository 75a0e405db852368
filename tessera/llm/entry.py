"""The training-data queries, each its operator over its whole table.

Nulls, repeated rows, ties, empty tables and texts of any length give what the
operators' modules state; each query has one row for each row of its table, the
search ``k`` rows at most for each query vector.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cotraining, exponion, linededup, minhash, mixing, pii, quality_rules, substrings, suffix, topk, toxicity, whitening
from tessera.llm.storage import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document and its size; ``stays`` marks a class's first member."""
    small_batches(spark)
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("class_doc").alias("class_id"), "class_size", "stays")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of what is left of every document, for strings of 100 bytes."""
    found = suffix.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words and lines, base verdict and the verdict of the line rules for every document."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, its source's size and target, and the words the mix takes of every document."""
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    return plan.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both views, their blend and the verdict for every document."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, _table(spark, sf_dir, "labels"))
    scored = cotraining.score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return scored.select("row.doc_id", "text_score", "meta_score", "score", "kept")


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of base spans, and all spans, of every document; n_spans counts them all."""
    small_batches(spark)
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda name, spans: F.transform(spans, lambda x: F.concat_ws(":", F.lit(name), x["start"].cast("string"), x["end"].cast("string")))
    terms = F.coalesce("added", F.array())
    more = F.array_join(F.concat(listed("secret", F.col("secrets")), listed("term", terms)), ",")
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(more, F.lit("")))
    size = lambda x: F.size(x).cast("long")
    n_base = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")
    digest = F.sha2("base", 256).alias("base_sha256")
    return found.select(F.col("doc").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", digest, spans.alias("spans"), size("secrets").alias("n_secret"), size(terms).alias("n_terms"), (n_base + size("secrets") + size(terms)).alias("n_spans"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every query (ids divisible by 50) by integer inner product."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


OP7_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without the lines that stand in ten documents (rows) or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = linededup.keep_bitmaps(docs, min_docs=10, min_chars=1)
    return linededup.drop_lines(docs, bitmaps).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH numbered AS (
    SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
    SELECT doc, doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM numbered
), keyed AS (
    SELECT doc, doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY k.doc
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of token ids, and digest of the decoded bytes, of every document."""
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, and whether its label was held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of what is left of every document, for windows of 13 words."""
    small_batches(spark)
    found = substrings.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


OP11_SQL = """
WITH numbered AS (
    SELECT row_number() OVER () AS doc, doc_id, coalesce(doc_id, 9223372036854775807) AS place,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), starts AS (
    SELECT doc, place, words, unnest(range(1, len(words) - 11)) AS k FROM numbered WHERE len(words) >= 13
), keyed AS (
    SELECT doc, place, k, array_to_string(words[k:k + 12], ' ') AS w FROM starts
), firsts AS (
    SELECT w, min(place) AS first FROM keyed GROUP BY w
), covered AS (
    SELECT DISTINCT doc, unnest(range(k, k + 13)) AS pos FROM keyed JOIN firsts USING (w) WHERE first < place
), spread AS (
    SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM numbered
), cut AS (
    SELECT s.doc, s.pos, s.word, c.pos IS NOT NULL AS gone,
           c.pos IS NOT NULL AND lag(c.pos) OVER (PARTITION BY s.doc ORDER BY s.pos) IS NULL AS opens
    FROM spread s LEFT JOIN covered c ON s.doc = c.doc AND s.pos = c.pos
), summed AS (
    SELECT doc, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
           string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
    FROM cut GROUP BY doc
)
SELECT n.doc_id, len(n.words) AS n_words, coalesce(s.n_removed, 0) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256, coalesce(s.n_spans, 0) AS n_spans
FROM numbered n LEFT JOIN summed s ON n.doc = s.doc
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of every usable vector, and its values along the eight widest components."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
    return found.select(F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue")


def op13_exponion_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after five rounds from 40 drawn centroids."""
    found = exponion.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after another: ``m`` assigns vectors to the centroids ``c`` before, by all distances."""
    steps = [f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v
    FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}) t
)"""]
    for turn in range(rounds + 1):
        steps.append(f"""m{turn} AS (
    SELECT vec_id, v, min(struct_pack(d := d, number := number)) AS best FROM (
        SELECT p.vec_id, p.v, c.number, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d
        FROM kept p CROSS JOIN c{turn} c
    ) t GROUP BY vec_id, v
)""")
        if turn < rounds:
            steps.append(f"""c{turn + 1} AS (
    SELECT c.number, coalesce(u.v, c.v) AS v FROM c{turn} c LEFT JOIN (
        SELECT number, list(CAST(floor(s::DOUBLE / n) AS BIGINT) ORDER BY k) AS v FROM (
            SELECT number, k, sum(x) AS s, count(*) AS n FROM (
                SELECT best.number AS number, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM m{turn}
            ) t GROUP BY number, k
        ) t GROUP BY number
    ) u ON c.number = u.number
)""")
    return ", ".join(steps) + f"""
SELECT m.vec_id, CAST(m.best.number AS INTEGER) AS cluster, m.best.d AS distance,
       CAST(sum(m.best.d) OVER (PARTITION BY m.best.number) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM m{rounds} m JOIN c{rounds} c ON m.best.number = c.number
"""


def queries():
    return {f.__name__: f for f in (op1_minhash_neardup, op2_suffix_dedup, op3_quality_rules, op4_budget_mixing, op5_quality_cotraining, op6_pii_disclosure, op7_exact_topk, op8_line_dedup, op9_byte_bpe, op10_toxicity, op11_substring_dedup, op12_embedding_whitening, op13_exponion_clustering)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op13_exponion_clustering": op13_sql()}
