"""Images as bytes: from files, base64 texts or a fetch function, with format and size from their headers."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.functions import text as t

#: The JPEG markers whose segment holds the size, and those without a segment.
_JPEG_SIZES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
_JPEG_BARE = {0x01, *range(0xD0, 0xDA)}


def header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) of PNG, GIF, JPEG and WebP; nulls where the header can't be read."""
    if not data:
        return None, None, None
    number = lambda a, n, order: int.from_bytes(data[a : a + n], order)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", number(16, 4, "big"), number(20, 4, "big")) if len(data) >= 24 and data[12:16] == b"IHDR" else ("png", None, None)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return ("gif", number(6, 2, "little"), number(8, 2, "little")) if len(data) >= 10 else ("gif", None, None)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X" and len(data) >= 30:
            return "webp", number(24, 3, "little") + 1, number(27, 3, "little") + 1
        if kind == b"VP8 " and len(data) >= 30:
            return "webp", number(26, 2, "little") & 0x3FFF, number(28, 2, "little") & 0x3FFF
        if kind == b"VP8L" and len(data) >= 25:
            bits = number(21, 4, "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return "webp", None, None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF:  # filling
                at += 1
            elif mark in _JPEG_BARE:
                at += 2
            elif mark in _JPEG_SIZES:
                return ("jpeg", number(at + 7, 2, "big"), number(at + 5, 2, "big")) if at + 9 <= len(data) else ("jpeg", None, None)
            else:
                at += 2 + number(at + 2, 2, "big")
        return "jpeg", None, None
    return None, None, None


@pandas_udf(T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def described(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(None if x is None else bytes(x)) for x in data], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files below a folder; path is what stands below it."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/")) if root.startswith("file:") else root.rstrip("/")
    return read.select(F.regexp_replace(F.element_at(F.split("path", re.escape(base) + "/", 2), -1), "%20", " ").alias("path"), "content")


def load(rows: DataFrame, column: str, root: str | None = None, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """``rows`` with kind, content, format, width, height and error of the image that a text column names.

    Base64 texts and data URIs are decoded, paths below ``root`` are joined with
    its files, which Spark reads, and URLs go to ``fetch``. What can't be loaded
    has a null content and says why.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("kind", F.when(F.col(column).startswith("data:image"), "base64").otherwise(t.image_kind(F.col(column))))
    found = files(spark, root) if root else spark.createDataFrame([], "path string, content binary")
    joined = marked.join(found.select(F.col("path").alias("_path"), F.col("content").alias("_file")), (F.col("kind") == "path") & (F.regexp_replace(column, r"^\./", "") == F.col("_path")), "left")

    @pandas_udf("content binary, error string")
    def fetched(urls: pd.Series) -> pd.DataFrame:
        out: list[tuple[bytes | None, str | None]] = []
        for url in urls:
            try:
                out.append((fetch(url), None) if fetch and url is not None else (None, None if url is None else "no fetch function"))
            except Exception as e:  # the error is this image's result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["content", "error"])

    got = joined.withColumn("_got", fetched(F.when(F.col("kind") == "url", F.col(column))))
    content = F.when(F.col("kind") == "base64", t.decode_base64(F.col(column))).when(F.col("kind") == "url", F.col("_got.content")).otherwise(F.col("_file"))
    sized = got.withColumn("content", content).withColumn("_d", described("content"))
    why = F.when(F.col("kind") == "empty", "no image").when(F.col("_got.error").isNotNull(), F.col("_got.error")).when(F.col("content").isNull(), F.when(F.col("kind") == "path", "no such file").otherwise("no base64")).when(F.col("_d.format").isNull(), "no image format")
    return sized.select(*rows.columns, "kind", "content", "_d.format", "_d.width", "_d.height", why.alias("error"))


def write_files(rows: DataFrame, path: str, content: str, root: str) -> int:
    """Write each row's bytes as a file below ``root``, which all machines share; gives the number of files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root) if re.match(r"[a-z0-9+.-]+:/", root) else (pafs.LocalFileSystem(), root)
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                place = posixpath.join(base, name)
                fs.create_dir(posixpath.dirname(place), recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
