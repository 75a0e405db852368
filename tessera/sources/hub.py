"""Dataset folders in the layout of a hub, as a Spark data source.

A dataset is ``<root>/<config>/<split>...``: one shard is a Parquet or JSON
lines file named ``<split>.parquet``, ``<split>-00000-of-00004.parquet`` or
``<split>/anything.parquet``. The config ``default`` is also the root itself.

    hub.register(spark)
    test = spark.read.format("hub").load(root).where("split = 'test'")
    live = spark.readStream.format("hub").option("split", "train").load(root)

Rows have the shards' columns and ``split``. A filter on ``split``, like the
option of that name, leaves other shards unread; so do row groups whose
statistics a shard has no use for: a task takes one row group, and reads the
columns of the given schema only. The stream takes shards by name, so that a new
shard must come after those before it.
"""

from __future__ import annotations

import posixpath
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

_SHARD = re.compile(r"(?P<split>[A-Za-z0-9_.]+?)(-\d+-of-\d+)?\.(parquet|jsonl|json)")
_KINDS = (".parquet", ".jsonl", ".json")
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class HubError(RuntimeError):
    """A dataset that can't be read as asked for, with what could be asked for."""


@dataclass(frozen=True)
class Shard:
    split: str
    path: str  # below the dataset's folder


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z0-9+.-]+://|file:/", root):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _children(fs: pafs.FileSystem, folder: str, deep: bool = False) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=deep))
    return [f for f in found if not posixpath.basename(f.path).startswith((".", "_"))]


def configs(root: str) -> list[str]:
    """Names of the folders that have shards, ``default`` for the root itself."""
    fs, base = _open(root)
    named = sorted(posixpath.basename(f.path) for f in _children(fs, base) if f.type == pafs.FileType.Directory and shards(root, posixpath.basename(f.path), strict=False))
    return named if "default" in named or not shards(root, None, strict=False) else ["default", *named]


def shards(root: str, config: str | None = None, strict: bool = True) -> list[Shard]:
    """The shards of a config, by name; ``default`` or nothing is the folder of that name, or the root."""
    fs, base = _open(root)
    folder = posixpath.join(base, config) if config else base
    if config in (None, "default"):
        own = posixpath.join(base, "default")
        folder = own if fs.get_file_info(own).type == pafs.FileType.Directory else base
    out = []
    for f in _children(fs, folder):
        if f.type == pafs.FileType.File and (m := _SHARD.fullmatch(posixpath.basename(f.path))):
            out.append(Shard(m["split"], f.path))
        elif f.type == pafs.FileType.Directory and (folder != base or config == "default" or _looks_like_split(fs, f.path)):
            out += [Shard(posixpath.basename(f.path), g.path) for g in _children(fs, f.path, deep=True) if g.type == pafs.FileType.File and g.path.endswith(_KINDS)]
    if strict and not out:
        raise HubError(f"no shards in {folder}; configs: {configs(root)}")
    return sorted(out, key=lambda s: s.path)


def _looks_like_split(fs: pafs.FileSystem, folder: str) -> bool:
    """A folder of Spark's parts right below the root is a split, one of named shards or of folders is a config."""
    return any(posixpath.basename(f.path).startswith("part-") for f in _children(fs, folder))


def chosen(root: str, config: str | None, split: str | None) -> list[Shard]:
    """The shards of a split, or of all; a split that isn't there is named with those that are."""
    found = shards(root, config)
    if split is None:
        return found
    mine = [s for s in found if s.split == split]
    if not mine:
        there = sorted({s.split for s in found})
        warnings.warn(f"split {split!r} isn't among {there}", stacklevel=2)
        raise HubError(f"no split {split!r} in config {config or 'default'!r}; splits: {there}; configs: {configs(root)}")
    return mine


def _arrow_schema(root: str, shard: Shard) -> pa.Schema:
    fs, _ = _open(root)
    with fs.open_input_file(shard.path) as f:
        if shard.path.endswith(".parquet"):
            return pq.read_schema(f).remove_metadata()
        return pajson.read_json(f).schema


@dataclass
class Piece(InputPartition):
    """A row group of a Parquet shard, or a whole JSON lines shard."""

    shard: Shard
    group: int | None = None


def _pieces(root: str, found: list[Shard]) -> list[Piece]:
    fs, out = _open(root)[0], []
    for s in found:
        if s.path.endswith(".parquet"):
            with fs.open_input_file(s.path) as f:
                out += [Piece(s, g) for g in range(pq.ParquetFile(f).num_row_groups)]
        else:
            out.append(Piece(s))
    return out


def _read(root: str, piece: Piece, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    target = to_arrow_schema(schema)
    names = [f.name for f in target if f.name != "split"]
    with _open(root)[0].open_input_file(piece.shard.path) as f:
        if piece.group is None:
            batches = pajson.read_json(f).to_batches(max_chunksize=4096)
        else:
            whole = pq.ParquetFile(f)
            there = [n for n in names if n in whole.schema_arrow.names]
            batches = whole.iter_batches(batch_size=4096, row_groups=[piece.group], columns=there)
        for b in batches:
            have = set(b.schema.names)
            columns = [pa.array([piece.shard.split] * b.num_rows, pa.string()) if x.name == "split" else b.column(x.name).cast(x.type) if x.name in have else pa.nulls(b.num_rows, x.type) for x in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)


class HubReader(DataSourceReader):
    def __init__(self, root: str, config: str | None, split: str | None, schema: T.StructType):
        self.root, self.config, self.split, self.schema = root, config, split, schema
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Take the filters on ``split``; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("split",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Piece]:
        found = chosen(self.root, self.config, self.split)
        return _pieces(self.root, [s for s in found if self.wanted is None or s.split in self.wanted]) or [Piece(Shard("", ""))]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition, self.schema) if partition.shard.path else iter(())


class HubStream(DataSourceStreamReader):
    """Offsets are the name of the last shard taken."""

    def __init__(self, root: str, config: str | None, split: str | None, schema: T.StructType):
        self.root, self.config, self.split, self.schema = root, config, split, schema

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(s.path for s in chosen(self.root, self.config, self.split))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces(self.root, [s for s in chosen(self.root, self.config, self.split) if start["after"] < s.path <= end["after"]])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition, self.schema)


class Hub(DataSource):
    """Options: path, config (``default``), split (all)."""

    @classmethod
    def name(cls) -> str:
        return "hub"

    def _asked(self) -> tuple[str, str | None, str | None]:
        config = self.options.get("config")
        return self.options["path"], None if config == "default" else config, self.options.get("split")

    def schema(self) -> T.StructType:
        found = chosen(*self._asked())
        own = from_arrow_schema(_arrow_schema(self.options["path"], found[0]))
        return T.StructType([*[f for f in own.fields if f.name != "split"], T.StructField("split", T.StringType())])

    def reader(self, schema: T.StructType) -> HubReader:
        return HubReader(*self._asked(), schema)

    def streamReader(self, schema: T.StructType) -> HubStream:
        return HubStream(*self._asked(), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it (a setting of the session)."""
    spark.dataSource.register(Hub)
    spark.conf.set(_PUSHDOWN, "true")


def load(spark: SparkSession, root: str, split: str | None = None, config: str | None = None, stream: bool = False, schema=None) -> DataFrame:
    """A dataset, or one of its splits, as a table or as a stream."""
    register(spark)
    read = (spark.readStream if stream else spark.read).format("hub")
    for name, value in (("split", split), ("config", config)):
        read = read.option(name, value) if value is not None else read
    return (read.schema(schema) if schema is not None else read).load(root)
