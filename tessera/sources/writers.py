"""Writers: JSON, JSON lines, CSV, text and nested cluster files, one part for each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path)


def text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(column).write.mode(mode).text(path)


def by_split(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder for each split; a split without rows isn't written."""
    df.write.mode(mode).partitionBy("split").format(fmt).save(path)


def by_cluster(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each cluster that has samples."""
    samples.where(F.col("cluster_id").isNotNull()).write.mode(mode).partitionBy("cluster_id").json(path)


def cluster_records(labelled: DataFrame, key: str, label: str, value, most: int) -> DataFrame:
    """(cluster_id, part, size, percentage, samples): a cluster in parts of about ``most`` samples, in order of their keys.

    Parts are drawn by hash, so that no record and no task holds a large cluster.
    """
    sizes = labelled.groupBy(F.col(label).alias("_cluster")).agg(F.count("*").alias("_size"))
    total = labelled.agg(F.count("*").alias("_total"))
    known = sizes.join(F.broadcast(total), F.lit(True)).select("_cluster", "_size", (F.col("_size") * 100.0 / F.col("_total")).alias("_percentage"))
    rows = labelled.select(F.col(label).alias("_label"), F.struct(F.col(key).alias("k"), value.alias("v")).alias("_x")).join(known, F.col("_label").eqNullSafe(F.col("_cluster")))
    part = F.pmod(F.xxhash64("_x.k"), F.ceil(F.col("_size") / most)).cast("int").alias("part")
    grouped = rows.groupBy("_cluster", part, "_size", "_percentage").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    return grouped.select(F.col("_cluster").alias("cluster_id"), "part", F.col("_size").alias("size"), F.col("_percentage").alias("percentage"), F.transform("_x", lambda x: x["v"]).alias("samples"))


def cluster_documents(labelled: DataFrame, key: str = "sample_id", label: str = "cluster_id", most: int = 100_000) -> DataFrame:
    """(cluster_id, part, size, percentage, samples): clusters with the ids of their samples; noise is one of them."""
    return cluster_records(labelled, key, label, F.col(key), most)


def cluster_file(labelled: DataFrame, path: str, columns: list[str], key: str = "sample_id", label: str = "cluster_id", most: int = 1000, mode: str = "overwrite") -> None:
    """Cluster records with their samples inside, as JSON lines, clusters in order; noise counts as a cluster."""
    sample = F.struct(F.col(key).alias("sample_id"), F.col(label).alias("cluster_id"), F.struct(*columns).alias("data"))
    cluster_records(labelled, key, label, sample, most).repartitionByRange("cluster_id", "part").sortWithinPartitions("cluster_id", "part").write.mode(mode).option("ignoreNullFields", False).json(path)


def benchmark_report(summary: DataFrame, path: str, poor_below: float = 0.7, mode: str = "overwrite") -> None:
    """A record for each benchmark with its figures and whether it is a poor performer."""
    jsonl(summary.withColumn("is_poor_performer", F.col("accuracy") < poor_below), path, mode)


def evaluation_triples(evaluated: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Evaluation records as one JSON line for each sample, its graders side by side."""
    from tessera.operators.scoring import as_triples

    jsonl(as_triples(evaluated), path, mode)


def batch_report(hard: DataFrame, merged: DataFrame, statistics: DataFrame, prompt: DataFrame, path: str, mode: str = "overwrite") -> None:
    """What a batch leaves: hard cases, merged metrics and figures as JSON lines, and its prompt (one text column) as text."""
    for name, rows in (("hard_cases", hard), ("merged_metrics", merged), ("statistics", statistics)):
        jsonl(rows, f"{path}/{name}", mode)
    text(prompt, prompt.columns[0], f"{path}/prompt", mode)


def results(rows: DataFrame, path: str, line: Column, mode: str = "overwrite") -> None:
    """Inference results twice: as JSON lines, and as text with one readable ``line`` for each."""
    jsonl(rows, f"{path}/json", mode)
    text(rows.select(line.alias("value")), "value", f"{path}/text", mode)


def preview(df: DataFrame, n: int = 3, order: str | None = None) -> list[dict]:
    rows = df.orderBy(order).limit(n) if order else df.limit(n)
    return [r.asDict(True) for r in rows.collect()]


def preview_markdown(df: DataFrame, n: int = 3, order: str | None = None) -> str:
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", "<br>")
    rows = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(rows + ["| " + " | ".join(cell(v) for v in r.values()) + " |" for r in preview(df, n, order)]) + "\n"


def preview_html(df: DataFrame, n: int = 3, order: str | None = None) -> str:
    from html import escape

    cell = lambda v: escape(str(v)).replace("\n", "<br>")
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in preview(df, n, order))
    return f"<table><tr>{head}</tr>{body}</table>\n"
