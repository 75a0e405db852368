"""Readers: every format to a DataFrame, with explicit schemas and no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas

FORMATS = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".tsv": "tsv", ".txt": "txt", ".parquet": "parquet"}


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def jsonl(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. A bad line raises, or is dropped if not ``strict``."""
    if strict:
        return spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path)
    return parsed_lines(spark.read.text(path), schema).where(F.col("r._bad").isNull()).select("r.*").drop("_bad")


def parsed_lines(lines: DataFrame, schema) -> DataFrame:
    """(value, r) of the lines that aren't blank: r holds the record, and in _bad a line that isn't one."""
    marked = T.StructType([*_schema(schema).fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.where(F.trim("value") != "").select("value", F.from_json("value", marked, options).alias("r"))


def rejected(spark: SparkSession, path: str, schema) -> DataFrame:
    """The lines that ``jsonl`` drops when it isn't strict."""
    return parsed_lines(spark.read.text(path), schema).where(F.col("r._bad").isNotNull()).select("value")


def json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file with a list of records or with a single one."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).json(path)


def json_data(spark: SparkSession, path: str, schema, strict: bool = False) -> DataFrame:
    """A file with a list of records, a single one, or a list under "data"; no rows if there is no file.

    With ``strict``, as a file of tasks is read, a missing file and a single
    record are errors, and a name that ends in .jsonl is read line by line.
    """
    inner = _schema(schema)
    if strict and path.lower().endswith(".jsonl"):
        return jsonl(spark, path, inner)
    wide = T.StructType([*inner.fields, T.StructField("data", T.ArrayType(inner))])
    try:
        rows = spark.read.schema(wide).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if strict:
            raise FileNotFoundError(f"no file {path}") from e
        return spark.createDataFrame([], inner)
    own = F.array(F.struct(*[F.col(f.name) for f in inner.fields]))
    if strict:
        starts = spark.read.option("wholetext", True).text(path).select(F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")), 1, 1).alias("c")).distinct().collect()
        if any(r.c == "{" for r in starts) and not rows.where("data IS NULL").isEmpty():
            raise ValueError(f"{path} holds neither a list nor a list under data")
    return rows.select(F.inline(F.when(F.col("data").isNotNull(), F.col("data")).otherwise(own)))


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A header and text columns; quoted line breaks and doubled quotes are read.

    A quoted line break needs whole files as tasks; without any,
    ``multi_line=False`` lets Spark split large files.
    """
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("multiLine", multi_line).option("escape", '"').csv(path)


def numbered(lines: DataFrame) -> DataFrame:
    """(n, value): the number of each line of text files from 0, files and their blocks in order.

    Lines are counted in each block of a file first; one row for each block
    gives the number of its first line.
    """
    at = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    blocks = at.groupBy("f", "b").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(F.col("f").alias("file"), F.col("b").alias("block"), "first", before.alias("before"))
    joined = at.join(starts, (F.col("f") == F.col("file")) & (F.col("b") == F.col("block")))
    return joined.select((F.col("m") - F.col("first") + F.col("before")).alias("n"), "value")


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, text) of each line that isn't blank; id is its line number from 0, blank lines counted."""
    lines = numbered(spark.read.text(path))
    return lines.select(F.col("n").alias("id"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text")).where(F.col("text") != "")


def with_ordinal(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with ``ordinal``, the position among the lines that aren't blank."""
    lines = numbered(spark.read.text(path).where(F.trim("value") != ""))
    return lines.select(F.col("n").alias("ordinal"), F.from_json("value", _schema(schema), {"mode": "FAILFAST"}).alias("r")).select("ordinal", "r.*")


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row, n: the lines that aren't blank."""
    return spark.read.text(path).agg(F.count_if(F.trim("value") != "").alias("n"))


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, clean: bool = True) -> DataFrame:
    """Parquet, pruned to the columns that are there; NaN becomes null with ``clean``."""
    rows = spark.read.option("mergeSchema", True).parquet(*path) if isinstance(path, list) else spark.read.parquet(path)
    rows = rows.select(*[c for c in columns if c in rows.columns]) if columns else rows
    if not clean:
        return rows
    return rows.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in rows.schema])


def load(spark: SparkSession, path: str | list[str], schema=None, fmt: str | None = None) -> DataFrame:
    """Dispatch on the suffix, or ``fmt`` for a list of paths; an unknown one is an error."""
    fmt = fmt or next((f for s, f in FORMATS.items() if path.lower().rstrip("/").endswith(s)), None)
    if fmt in ("json", "jsonl"):
        if schema is None:
            raise ValueError("JSON needs a schema")
        return jsonl(spark, path, schema, strict=False) if fmt == "jsonl" else json(spark, path, schema)
    if fmt in ("csv", "tsv"):
        return csv(spark, path, "," if fmt == "csv" else "\t")
    if fmt == "txt":
        return text_lines(spark, path)
    if fmt == "parquet":
        return parquet(spark, path)
    raise ValueError(f"unsupported format: {path}")


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Paths of CSV files by their first line, which names the columns."""
    found: dict[str, list[str]] = {}
    for path in paths:  # a line of each file, no scan
        head = spark.read.text(path).limit(1).collect()
        found.setdefault(head[0]["value"] if head else "", []).append(path)
    return found


def files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths in a folder that match a pattern, by name; those with a leading . or _ are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    paths = sorted(str(x.getPath().toString()) for x in found)
    return [p for p in paths if p.rstrip("/").rsplit("/", 1)[-1][0] not in "._"]


def load_all(spark: SparkSession, paths: list[str], schema=None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Union of all files, columns that a file lacks as null; and (path, error) of the files that failed.

    Files of one format (CSV: and header) are one read. Only where that fails
    are its files tried one by one, to name the bad ones.
    """
    groups: dict[tuple, list[str]] = {}
    failed: list[tuple[str, str]] = []
    for path in paths:
        fmt = next((f for s, f in FORMATS.items() if path.lower().rstrip("/").endswith(s)), None)
        if fmt is None:
            failed.append((path, f"unsupported format: {path}"))
        else:
            groups.setdefault((fmt,), []).append(path)
    for fmt in ("csv", "tsv"):
        for path in groups.pop((fmt,), []):
            try:
                header = next(iter(_headers(spark, [path])))
            except Exception as e:
                failed.append((path, str(e).splitlines()[0]))
                continue
            groups.setdefault((fmt, header), []).append(path)

    def tried(own: list[str], fmt: str):
        rows = load(spark, own, schema, fmt)
        rows.limit(1).collect()
        return rows

    parts = []
    for (fmt, *_), own in groups.items():
        try:
            parts.append(tried(own, fmt))
            continue
        except Exception as e:
            if len(own) == 1:
                failed.append((own[0], str(e).splitlines()[0]))
                continue
        good = []
        for path in own:
            try:
                tried([path], fmt)
                good.append(path)
            except Exception as e:
                failed.append((path, str(e).splitlines()[0]))
        if good:
            parts.append(load(spark, good, schema, fmt))
    found = None
    for rows in parts:
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found, failed


def load_folder(spark: SparkSession, folder: str, schema=None, pattern: str = "*") -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """``load_all`` over the files of a folder."""
    return load_all(spark, files(spark, folder, pattern), schema)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, size, sample_id, data) of a cluster file."""
    rows = json(spark, path, schemas.CLUSTER_FILE).select(F.explode("clusters").alias("c"))
    return rows.select("c.cluster_id", "c.size", F.explode("c.samples").alias("s")).select("cluster_id", "size", "s.sample_id", "s.data")


def cluster_samples(spark: SparkSession, pattern: str) -> DataFrame:
    """Samples of all sampled cluster files, with the file's name to order by."""
    rows = spark.read.schema(_schema(schemas.CLUSTER_SAMPLES)).option("multiLine", True).json(pattern)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.inline("samples"))


def evaluation_triples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    read = spark.read.schema(_schema(schemas.EVALUATION_TRIPLE))
    return read.option("mode", "FAILFAST").json(path) if lines else read.option("multiLine", True).json(path)


def grader_rows(triples: DataFrame) -> DataFrame:
    """Evaluation triples as one row for each sample and grader, for the scoring operators."""
    graders = ("weak", "normal", "sota")
    sample = F.coalesce(F.nullif("sample_id", F.lit("")), *[F.nullif(f"{g}.sample_id", F.lit("")) for g in graders], F.lit("unknown"))
    entry = lambda g: F.struct(F.lit(g).alias("cap"), F.col(f"{g}.correctness_score").alias("corr"), F.col(f"{g}.correctness_confidence").alias("corr_conf"), F.col(f"{g}.training_quality_score").alias("train"), F.col(f"{g}.training_quality_confidence").alias("train_conf"), F.coalesce(F.size(f"{g}.recommended_metrics"), F.lit(0)).alias("n_metrics"), F.col(f"{g}.recommended_metrics").alias("metrics"))
    rows = triples.select(sample.alias("sample_id"), F.inline(F.array(*[entry(g) for g in graders])))
    return rows.where(F.col("corr").isNotNull())


def benchmark_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries by name; of a repeated name the last one."""
    rows = json(spark, path, schemas.BENCHMARK_CATALOG).select(F.posexplode("benchmarks").alias("n", "b"))
    last = rows.groupBy("b.name").agg(F.max(F.struct("n", "b")).alias("x"))
    return last.select("x.b.*")


def agent_plan(spark: SparkSession, path: str) -> DataFrame:
    return json(spark, path, schemas.AGENT_CATALOG)


def selection_input(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, schemas.SELECTION_INPUT)
